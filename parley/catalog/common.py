"""The same table mappings as parley.sources.adapters, written for the SQL check."""

INTERVALS = """
intervals AS (
  SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, 'SPEAKER_' || event_type AS speaker_id,
         CAST((epoch_us(ts) // 1000) % 86400000 AS BIGINT) AS start_ms,
         CAST((epoch_us(ts) // 1000) % 86400000 AS BIGINT) + CAST(round(value * 1000) AS BIGINT) AS end_ms,
         event_id AS interval_id
  FROM events)"""

SEGMENTS = """
segments AS (
  SELECT CAST(conv_id AS VARCHAR) AS meeting_id, conv_id || '-' || turn AS segment_id, conv_id, turn,
         CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker_id,
         CAST(sum(60 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - 60 * length(text) AS BIGINT) AS start_ms,
         CAST(sum(60 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms,
         text, (turn % 5 = 4) AS provisional
  FROM conversations)"""

OVERLAP_SEGMENTS = SEGMENTS + """,
overlap_segments AS (
  SELECT meeting_id, segment_id || '-' || k AS segment_id, conv_id, turn, start_ms, end_ms, text, provisional,
         (turn % 3 = 1) AS is_overlap, k AS copy,
         CASE WHEN turn % 3 = 1 THEN [speaker_id, CASE WHEN speaker_id = 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END]
              ELSE [] END AS overlap_speakers,
         CASE WHEN k = 0 THEN speaker_id WHEN speaker_id = 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END AS speaker_id
  FROM segments, (VALUES (0), (1)) c(k)
  WHERE k = 0 OR turn % 3 = 1)"""

WINDOWS = SEGMENTS + """,
stt_windows AS (
  SELECT strftime(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER), '%Y-%m-%d') AS meeting_id, conv_id, turn,
         start_ms + ((conv_id // 30) * 400000) % 80000000 AS start_ms,
         end_ms + ((conv_id // 30) * 400000) % 80000000 AS end_ms, text
  FROM segments)"""

FRAMES = """
frames AS (
  SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_type AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         (value - 245) / 245 AS x, value, event_id
  FROM events)"""

SP = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"


def strip(x):
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def squeeze(x):
    return strip(f"regexp_replace({x}, '{SP}+', ' ', 'g')")


def words(x):
    return f"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda e: e <> '')"


def tokens(x):
    return f"regexp_extract_all(lower({x}), '({WORD})', 1)"


def norm_tokens(x):
    return f"regexp_extract_all(translate({x}, 'يك\u200c\u200d', 'یک'), '({WORD})', 1)"


PAIRS = f"""
pw AS (SELECT conv_id, turn, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS after,
              {words('text')} AS w FROM conversations),
pairs AS (
  SELECT conv_id, turn, 'hop' AS kind, array_to_string(w[1:(len(w) * 6) // 10], ' ') AS a,
         array_to_string(w[(len(w) * 3) // 10 + 1:(len(w) * 3) // 10 + (len(w) * 6) // 10], ' ') AS b FROM pw
  UNION ALL SELECT conv_id, turn, 'next', text, after FROM pw
  UNION ALL SELECT conv_id, turn, 'edit', text, array_to_string(list_filter(w, lambda x, i: i % 7 <> 0), ' ') FROM pw
  UNION ALL SELECT conv_id, turn, 'cut', text, array_to_string(w[1:(len(w) * 3) // 10], ' ') FROM pw)"""

TAGS = ["(Coughs)", "[ blank_audio ]", "Music", "♪ music ♪", "(Clearing  throat)", "...", "?", "", "(door slams)",
        "[Background_Music] Thanks for watching", "Subscribe", "12 34", "music _ _ _ _", "music ، ، ، ،"]

NOISY = f"""
nd AS (SELECT *, {words('text')} AS w, {TAGS!r}[doc_id % {len(TAGS)} + 1] AS tag FROM documents),
noisy AS (
  SELECT doc_id, 'plain' AS form, text, 'en' AS language FROM nd
  UNION ALL SELECT doc_id, 'tag', tag, 'en' FROM nd
  UNION ALL SELECT doc_id, 'tagged', tag || ' ' || text, 'fa' FROM nd
  UNION ALL SELECT doc_id, 'loop', repeat(coalesce(w[1], 'x') || ' ', doc_id % 12 + 1), 'en' FROM nd
  UNION ALL SELECT doc_id, 'script', translate(text, 'aeiounrst', 'ایهوینرست'), 'fa' FROM nd
  UNION ALL SELECT doc_id, 'script2', translate(text, 'aeiou', 'ایهوی'), 'fa' FROM nd)"""
