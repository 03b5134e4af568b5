"""Registered queries from windows to transcripts and from transcripts to minutes, with their SQL."""

from pyspark.sql import functions as F

from parley.catalog.common import INTERVALS, NOISY, OVERLAP_SEGMENTS, WINDOWS, strip, words
from parley.catalog.intervals import REGIONS
from parley.catalog.text import DF, score
from parley.functions import documents as doc, quality, text as tx
from parley.operators import frames as fr, intervals as iv, minutes as mn, packing as pk, reconcile as rc, recordings as rec, review as rv
from parley.plans.kept import keep
from parley.plans.slabs import side_by_side
from parley.sources import adapters as src

C = F.col
CONV = ["meeting_id", "conv_id"]
EMPTY = "array<string>"


def w6(spark, d):
    """Short turns here are those under 20 s, as turns of the events last about 50 s."""
    i = iv.mark_overlaps(src.intervals(spark, d), ["meeting_id"])
    return rc.absorb_short_turns(i, ["meeting_id"], min_ms=20_000)


def w10(spark, d):
    s = src.stt_windows(spark, d).withColumn("w", tx.words(C("text")))
    n, length = F.size("w"), C("end_ms") - C("start_ms")
    at = lambda i: C("start_ms") + F.floor(i * C("len") / C("n"))
    s = s.withColumn("n", n).withColumn("len", length)
    w = s.select("meeting_id", "conv_id", "turn", F.posexplode(F.transform("w", lambda t, i: F.struct(
        t.alias("word"), at(i).alias("start_ms"), at(i + 1).alias("end_ms")))).alias("pos", "x")).select(
        "meeting_id", "conv_id", "turn", "pos", "x.*")
    i = src.intervals(spark, d)
    return rc.speaker_runs(w, i, iv.shared_regions(i, named_from_ms=iv.MIN_REGION_MS), ["meeting_id", "conv_id", "turn"]).select(
        "conv_id", "turn", "speaker_id", "start_ms", "end_ms", "text", "is_overlap")


def t1(spark, d):
    return rc.collapse_windows(src.hop_windows(spark, d), CONV).withColumn("n_words", F.size("words")).drop("words")


def u1(spark, d):
    """Words of the collapsed windows: the union of the hop windows' word timings."""
    return rc.collapse_windows(src.hop_windows(spark, d), CONV).select(
        *CONV, "start_ms", F.posexplode("words").alias("pos", "w")).select(*CONV, C("start_ms").alias("window_ms"), "pos", "w.*")


def segment_rows(df):
    return df.withColumn("overlap_speakers", F.array_join("overlap_speakers", ","))


def t2(spark, d):
    return segment_rows(rc.dedupe_segments(src.day_segments(spark, d), CONV))


def t3(spark, d):
    return segment_rows(rc.merge_adjacent(src.day_segments(spark, d), CONV))


def t4(spark, d):
    return segment_rows(rc.align_windows(src.hop_windows(spark, d), src.intervals(spark, d), CONV))


def t4_text(spark, d):
    """Without word times, as the live view does."""
    w = src.hop_windows(spark, d).withColumn("words", F.array().cast(rc.WORDS))
    return segment_rows(rc.align_windows(w, src.intervals(spark, d), CONV, provisional=True))


def shaky_segments(spark, d):
    """Segments of which some loop, and some are only tags."""
    s = src.overlap_segments(spark, d)
    looped = F.repeat(F.concat(F.get(tx.words(C("text")), F.lit(0)), F.lit(" ")), (C("turn") + 2).cast("int"))
    text = F.when(C("turn") % 4 == 1, F.concat(looped, C("text"))).when(C("turn") % 4 == 3, looped).otherwise(C("text"))
    return s.withColumn("text", text).withColumn("ord", F.struct("start_ms", "segment_id"))


def reviewer(batches):
    """Stands in for a model: the answer follows from the text itself."""
    asked = F.element_at(F.array(F.lit("keep"), F.lit("fix"), F.lit("drop"), F.lit("fix")), (F.length("text") % 4 + 1).cast("int"))
    edited = F.array_join(tx.collapse_runs(tx.words(C("text"))), " ")
    return batches.select("meeting_id", "text", asked.alias("verdict"), edited.alias("edited"))


def t5(spark, d):
    out = rv.finalize_review(shaky_segments(spark, d), reviewer)
    return out.select("segment_id", "speaker_id", "start_ms", "end_ms", "text", "is_overlap")


def t6(spark, d):
    modes = F.array(*[F.lit(m) for m in ("off", "heuristic", " Live", "finalize", "?")])
    t = src.noisy_texts(spark, d).withColumn("mode", F.element_at(modes, (C("doc_id") % 5 + 1).cast("int")))
    return rv.gate_by_mode(t, "text", "mode", C("language")).select(
        "doc_id", "form", "review_mode", F.coalesce("accepted", F.lit("")).alias("accepted"))


def t6_decision(spark, d):
    """Whether a window passes, per review mode."""
    return t6(spark, d).select("doc_id", "form", "review_mode", (C("accepted") != "").alias("passed"))


def stt_answers(windows, spark, d, ids):
    """What a recogniser said for each window: utterances, picked by meeting and window number."""
    c = src.table(spark, d, "conversations").select("conv_id", C("turn").alias("say"), "text")
    turns = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    w = windows.withColumn("conv_id", C("meeting_id").cast("long"))
    w = side_by_side(w, turns, "conv_id", "left").withColumn("say", C("window_no") % C("n"))
    return side_by_side(w, c, ["conv_id", "say"], "left").withColumn("text", F.coalesce("text", F.lit(""))).select(*ids, "start_ms", "end_ms", "text", "window_no")


def recording_inputs(spark, d):
    """Windows of the recordings with what was recognised in them, and who is heard when."""
    frames = keep(src.speech_frames(spark, d), "frames")
    hop = dict(frame_ms=100, window_ms=2000, hop_ms=1500, min_rms=0.3)
    w = fr.hopping_windows(frames, ["meeting_id"], **hop).unionByName(fr.tail_window(frames, ["meeting_id"], **hop))
    said = stt_answers(w, spark, d, ["meeting_id"]).withColumn("words", F.array().cast(rc.WORDS)).withColumnRenamed("window_no", "window_id")
    turns = iv.label_runs(frames, ["meeting_id"], "frame_idx", "stream_id", 1, 50_000).select(
        "meeting_id", F.concat(F.lit("SPEAKER_"), "stream_id").alias("speaker_id"), (C("run_start") * 100).alias("start_ms"),
        (C("run_end") * 100).alias("end_ms"), F.lit(False).alias("is_overlap"), C("run_start").alias("interval_id"))
    return said, keep(turns, "turns")


def t7(spark, d):
    """Recordings of all meetings to reviewed segments in one job."""
    said, turns = recording_inputs(spark, d)
    return rec.reviewed(said, turns, reviewer).select("meeting_id", "speaker_id", "start_ms", "end_ms", "text", "is_overlap")


def t8(spark, d):
    """One stream per speaker: no diarization, one interval per stream, slabs instead of hops."""
    frames = src.stream_frames(spark, d).persist()
    slabs = fr.stream_slabs(frames, ["meeting_id", "stream_id"], 100, 1600, slab_s=1, min_rms=0.3)
    said = stt_answers(slabs.withColumnRenamed("slab_no", "window_no"), spark, d, ["meeting_id", "stream_id"])
    gated = rv.gate_segments(said)
    seg = rc._plain(gated.select("meeting_id", F.concat(F.lit("SPEAKER_"), "stream_id").alias("speaker_id"), "start_ms", "end_ms", "text"))
    seg = rc.dedupe_segments(seg.withColumn("provisional", F.lit(False)), ["meeting_id"])
    seg = seg.withColumn("ord", F.struct("start_ms", "speaker_id", "text"))
    return rv.finalize_review(seg, reviewer).select("meeting_id", "speaker_id", "start_ms", "end_ms", "text")


def meeting_maps(spark, d):
    c = src.table(spark, d, "conversations").select("conv_id").distinct()
    return c.select(C("conv_id").cast("string").alias("meeting_id"), F.when(
        C("conv_id") % 2 == 0, F.create_map(F.lit("SPEAKER_00"), F.lit("Ann"))).otherwise(F.create_map().cast("map<string,string>")).alias("speaker_map"))


def lines(spark, d):
    return mn.transcript_lines(src.overlap_segments(spark, d), meeting_maps(spark, d))


def g5(spark, d):
    return lines(spark, d)


def u2(spark, d):
    return pk.split_lines(lines(spark, d), "meeting_id", "line_no", "line", 400).select("meeting_id", "line_no", "piece", "chunk", "text")


def u3(spark, d):
    t = src.documents(spark, d).select("lang", "doc_id", "text")
    return pk.batch_items(t, "lang", "doc_id", "text").select("lang", "doc_id", "batch")


def k5(spark, d):
    t = src.documents(spark, d).select("lang", "doc_id", "text")
    b = pk.batch_items(t, "lang", "doc_id", "text", 20_000)
    folded = pk.fold_overflow(b.withColumnRenamed("batch", "chunk"), 4).groupBy("lang", "part").agg(
        F.count(F.lit(1)).alias("n_items"), F.lit("fold").alias("how"))
    first = pk.first_batches(b, 2).groupBy("lang", C("batch").alias("part")).agg(F.count(F.lit(1)).alias("n_items"), F.lit("first").alias("how"))
    return folded.unionByName(first)


def k3(spark, d):
    t = quality.with_score(src.noisy_texts(spark, d), "text", C("language"), batches=True)
    return pk.worst_items(t, "form", "text", "doc_id", 24).select("form", "doc_id", F.round("score", 6).alias("score"), "rank", "text")


def people(spark, d):
    return meeting_maps(spark, d).select("meeting_id", F.array(F.lit("user"), F.lit("assistant")).alias("attendees"))


def u4(spark, d):
    return mn.prompt_parts(lines(spark, d), people(spark, d), limit=400, max_parts=3)


def g6(spark, d):
    return mn.merge_heads(src.partials(spark, d))


def g6_summaries(spark, d):
    return mn.merge_summaries(src.partials(spark, d))


def g6_decisions(spark, d):
    return mn.merge_decisions(src.partials(spark, d), people(spark, d))


def t9(spark, d):
    p = src.partials(spark, d)
    said = p.withColumn("text", F.when(C("meeting_id").cast("long") % 5 == 0, "[music]").when(
        C("meeting_id").cast("long") % 7 == 0, " ").otherwise(C("text")))
    return mn.minutes(p, people(spark, d), mn.speech_status(said)).withColumn("attendees", F.array_join("attendees", ","))


QUERIES = {
    "w6_absorb_short_turns": w6, "w10_speaker_runs": w10, "t1_collapse_windows": t1, "u1_word_union": u1,
    "t2_dedupe_segments": t2, "t3_merge_adjacent": t3, "t4_align_windows": t4, "t4_align_text_only": t4_text,
    "t5_finalize_review": t5, "t6_review_modes": t6, "t6_mode_decision": t6_decision, "t7_recordings": t7, "t8_streams_to_segments": t8,
    "g5_transcript_lines": g5, "u2_line_split": u2, "u3_batch_pack": u3, "u4_prompt_parts": u4, "k3_worst_items": k3,
    "k5_batch_caps": k5, "g6_merge_heads": g6, "g6_merge_summaries": g6_summaries, "g6_merge_decisions": g6_decisions, "t9_minutes": t9,
}

# ---- SQL -----------------------------------------------------------------------------------

MARKED = """
marked AS (SELECT a.*, EXISTS (SELECT 1 FROM intervals b WHERE b.meeting_id = a.meeting_id AND b.speaker_id <> a.speaker_id
    AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)) AS ov FROM intervals a)"""

CLOCK = lambda c: f"CASE WHEN {c} // 60000 < 10 THEN '0' ELSE '' END || ({c} // 60000) || ':' || lpad(CAST(({c} // 1000) % 60 AS VARCHAR), 2, '0')"
ANN = lambda s: f"CASE WHEN conv_id % 2 = 0 AND {s} = 'SPEAKER_00' THEN 'Ann' ELSE {s} END"
LINES = f"""{OVERLAP_SEGMENTS},
ln AS (SELECT meeting_id, start_ms, segment_id, '[' || {CLOCK('start_ms')} || '-' || {CLOCK('end_ms')} || '] ' ||
    CASE WHEN is_overlap THEN {ANN('overlap_speakers[1]')} || ' + ' || {ANN('overlap_speakers[2]')} || ' [OVERLAP]' ELSE {ANN('speaker_id')} END || ': ' || text AS line
  FROM overlap_segments WHERE copy = 0),
sp AS (SELECT meeting_id, start_ms, segment_id, unnest(string_split(line, chr(10))) AS line, generate_subscripts(string_split(line, chr(10)), 1) AS sub FROM ln),
lines AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, segment_id, sub) AS line_no, line FROM sp)"""


def pack(rel, key, pos, size, limit, overhead, pieces):
    """CTE packed(key, pos, n, starts, chunk): greedy packing, one item after the other."""
    big = f"CAST(ceil(i.n / {limit}e0) AS BIGINT)" if pieces else "1"
    cost = "i.n" if pieces else f"i.n + {overhead}"
    more = f"i.n + {overhead}"
    return f"""items AS (SELECT {key}, {pos}, {size} AS n, row_number() OVER (PARTITION BY {key} ORDER BY {pos}) AS rn FROM {rel}),
    packed AS (SELECT {key}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS {pos}, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS used, CAST(0 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS upto
        FROM (SELECT DISTINCT {key} FROM items) UNION ALL
      SELECT i.{key}, i.rn, i.{pos}, i.n, CASE WHEN i.n > {limit} THEN -1 WHEN p.used < 0 OR p.used + {more} > {limit} THEN {cost} ELSE p.used + {more} END,
        CASE WHEN i.n > {limit} THEN {big} WHEN p.used < 0 OR p.used + {more} > {limit} THEN 1 ELSE 0 END,
        p.upto + CASE WHEN i.n > {limit} THEN {big} WHEN p.used < 0 OR p.used + {more} > {limit} THEN 1 ELSE 0 END
      FROM packed p JOIN items i ON i.{key} = p.{key} AND i.rn = p.rn + 1),
    chunks AS (SELECT {key}, {pos}, n, CASE WHEN starts > 0 THEN upto - starts + 1 ELSE upto END AS chunk FROM packed WHERE rn > 0)"""


U2 = f"""{LINES}, {pack('lines', 'meeting_id', 'line_no', 'length(line)', 400, 1, True)},
pieces AS (SELECT meeting_id, line_no, unnest(range(0, greatest(CAST(ceil(length(line) / 400e0) AS BIGINT), 1))) AS piece, chunk, line FROM chunks JOIN lines USING (meeting_id, line_no)),
u2 AS (SELECT meeting_id, line_no, piece, chunk + piece AS chunk, substring(line, CAST(piece * 400 + 1 AS BIGINT), 400) AS text FROM pieces)"""

PARTIALS = f"""
partials AS (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, conv_id, turn AS part, role, text,
   CASE WHEN turn % 2 = 1 THEN array_to_string(({words('text')})[1:3], ' ') ELSE '  ' END AS hint,
   CASE WHEN turn >= 2 THEN 'day ' || turn ELSE '' END AS mdate, CASE WHEN role = 'system' THEN '' ELSE {strip('text')} END AS summary FROM conversations),
heads AS (SELECT meeting_id, coalesce(arg_min({strip('hint')}, part) FILTER (WHERE {strip('hint')} <> ''), '') AS subject,
   coalesce(arg_min(mdate, part) FILTER (WHERE mdate <> ''), '') AS meeting_date, '' AS location,
   coalesce(string_agg(summary, ' ' ORDER BY part) FILTER (WHERE summary <> ''), '') AS s0 FROM partials GROUP BY 1),
merged AS (SELECT meeting_id, subject, meeting_date, location, CASE WHEN length(s0) > 1200 THEN regexp_replace(left(s0, 1197), '[\\s\\p{{Z}}]+$', '') || '…' ELSE s0 END AS summary FROM heads),
di AS (SELECT meeting_id, part, role, unnest(list_filter(list_transform(string_split(text, '.'), lambda s: {strip('s')}), lambda s: s <> '')) AS description,
   unnest(range(0, len(list_filter(list_transform(string_split(text, '.'), lambda s: {strip('s')}), lambda s: s <> '')))) AS pos FROM partials),
decisions AS (SELECT meeting_id, part, pos, description, CASE WHEN role IN ('user', 'assistant') THEN role ELSE '' END AS executor, 'soon' AS due_date, 'pending' AS status
   FROM di QUALIFY row_number() OVER (PARTITION BY meeting_id, lower(upper(replace(description, 'ß', 'ss'))) ORDER BY part, pos) = 1)"""

SQL = {
    "w6_absorb_short_turns": f"""WITH RECURSIVE {INTERVALS}, {MARKED},
        r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, speaker_id, interval_id) AS rn FROM marked),
        f AS (SELECT meeting_id, rn, speaker_id AS spk, start_ms AS s, end_ms AS e, ov, rn AS head FROM r WHERE rn = 1 UNION ALL
          SELECT r.meeting_id, r.rn, CASE WHEN a THEN f.spk ELSE r.speaker_id END, CASE WHEN a THEN f.s ELSE r.start_ms END, CASE WHEN a THEN greatest(f.e, r.end_ms) ELSE r.end_ms END,
            CASE WHEN NOT a THEN r.ov WHEN same THEN f.ov OR r.ov ELSE f.ov END, CASE WHEN a THEN f.head ELSE r.rn END
          FROM f JOIN r ON r.meeting_id = f.meeting_id AND r.rn = f.rn + 1,
            LATERAL (SELECT r.speaker_id = f.spk AND r.start_ms - f.e <= 120 AS same,
              (r.speaker_id = f.spk AND r.start_ms - f.e <= 120) OR (r.speaker_id <> f.spk AND r.end_ms - r.start_ms < 20000 AND r.start_ms - f.e <= 80) AS a) x)
        SELECT meeting_id, spk AS speaker_id, s AS start_ms, e AS end_ms, ov AS is_overlap FROM f QUALIFY row_number() OVER (PARTITION BY meeting_id, head ORDER BY rn DESC) = 1""",
    "t6_mode_decision": f"""WITH {NOISY}, {score('noisy', DF, lang='language')},
        m AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'live' ELSE 'finalize' END AS review_mode FROM scored)
        SELECT doc_id, form, review_mode, CASE WHEN review_mode <> 'off' THEN score >= 0.35e0
          ELSE NOT contains(reasons, 'whisper_boilerplate') AND length(t) >= 2 AND regexp_matches(t, '\\p{{L}}')
           AND NOT (score < 0.35e0 AND regexp_matches(reasons, '(^|;)(wrong_script|no_persian|latin_)')) END AS passed FROM m""",
    "g5_transcript_lines": f"WITH {LINES} SELECT * FROM lines",
    "u2_line_split": f"WITH RECURSIVE {U2} SELECT * FROM u2",
    "u3_batch_pack": f"WITH RECURSIVE {pack('documents', 'lang', 'doc_id', 'length(text)', 10000, 48, False)} SELECT lang, doc_id, chunk AS batch FROM chunks",
    "u4_prompt_parts": f"""WITH RECURSIVE {U2}, t AS (SELECT meeting_id, least(chunk, 3) AS part, chunk, string_agg(text, chr(10) ORDER BY line_no, piece) AS chunk_text FROM u2 GROUP BY ALL)
        SELECT meeting_id, part, chunk, max(part) OVER (PARTITION BY meeting_id) AS total, 'user, assistant' AS attendees, chunk_text,
          greatest(256, least(1536, 8192 - 320 - (770 + 4 + CAST(ceil((15 + length(chunk_text)) / 1.8e0) AS BIGINT)))) AS completion_cap FROM t""",
    "k3_worst_items": f"""WITH {NOISY}, {score('noisy', DF, lang='language')},
        o AS (SELECT form, t AS text, min(doc_id) AS doc_id, arg_min(score, doc_id) AS score FROM scored WHERE t <> '' AND (score < 0.92e0
          OR regexp_matches(reasons, 'word_run|latin|char_loop|low_unique|wrong_script|collapsed|tiny_vocab|no_persian|whisper_boilerplate')) GROUP BY ALL)
        SELECT form, doc_id, score, row_number() OVER (PARTITION BY form ORDER BY score, doc_id) AS rank, text FROM o QUALIFY rank <= 24""",
    "k5_batch_caps": f"""WITH RECURSIVE {pack('documents', 'lang', 'doc_id', 'length(text)', 20000, 48, False)}
        SELECT lang, least(chunk, 4) AS part, count(*) AS n_items, 'fold' AS how FROM chunks GROUP BY ALL
        UNION ALL SELECT lang, chunk, count(*), 'first' FROM chunks WHERE chunk <= 2 GROUP BY ALL""",
    "g6_merge_heads": f"WITH {PARTIALS} SELECT * FROM merged",
    "g6_merge_summaries": f"WITH {PARTIALS} SELECT meeting_id, part, summary FROM partials WHERE summary <> ''",
    "g6_merge_decisions": f"WITH {PARTIALS} SELECT * FROM decisions",
    "t9_minutes": f"""WITH {PARTIALS}, n AS (SELECT meeting_id, count(*) AS n FROM decisions GROUP BY 1),
        st AS (SELECT *, CASE WHEN CAST(meeting_id AS BIGINT) % 5 = 0 THEN 'noise' WHEN CAST(meeting_id AS BIGINT) % 7 = 0 THEN 'empty' ELSE 'speech' END AS status FROM merged LEFT JOIN n USING (meeting_id))
        SELECT meeting_id, CASE WHEN status = 'speech' THEN subject ELSE '' END AS subject, CASE WHEN status = 'speech' THEN meeting_date ELSE '' END AS meeting_date, location,
          'user,assistant' AS attendees, CASE status WHEN 'empty' THEN '{doc.EMPTY_SUMMARY}' WHEN 'noise' THEN '{doc.NOISE_SUMMARY}'
            ELSE CASE WHEN summary = '' AND coalesce(n, 0) = 0 THEN '{doc.MINUTES_FALLBACK}' ELSE summary END END AS summary,
          CASE WHEN status = 'speech' THEN coalesce(n, 0) ELSE 0 END AS n_decisions FROM st""",
}
SQL["w10_speaker_runs"] = f"""WITH {INTERVALS}, {WINDOWS}, {REGIONS}, multi AS (SELECT * FROM regions WHERE n_speakers >= 2),
    u AS (SELECT meeting_id, conv_id, turn, start_ms AS ws, end_ms - start_ms AS len, {words('text')} AS w FROM stt_windows),
    x AS (SELECT meeting_id, conv_id, turn, ws, len, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM u),
    k AS (SELECT meeting_id, conv_id, turn, pos, word, ws + (pos * len) // n AS s, ws + ((pos + 1) * len) // n AS e FROM x),
    hit AS (SELECT k.conv_id, k.turn, k.pos, arg_min(i.speaker_id, (i.start_ms, i.end_ms, i.speaker_id, i.interval_id)) AS spk
       FROM k JOIN intervals i ON i.meeting_id = k.meeting_id AND i.start_ms <= (k.s + k.e) // 2 AND (k.s + k.e) // 2 < i.end_ms GROUP BY ALL),
    sp AS (SELECT k.*, coalesce(spk, 'SPEAKER_00') AS spk FROM k LEFT JOIN hit USING (conv_id, turn, pos)),
    ch AS (SELECT *, CASE WHEN lag(spk) OVER (PARTITION BY conv_id, turn ORDER BY pos) <> spk THEN 1 ELSE 0 END AS c FROM sp),
    rn AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM ch),
    runs AS (SELECT meeting_id, conv_id, turn, run, any_value(spk) AS spk, arg_min(s, pos) AS s, max(e) AS e, string_agg(word, ' ' ORDER BY pos) AS text FROM rn GROUP BY ALL),
    piece AS (SELECT r.conv_id, r.turn, r.run, m.meeting_id, m.region_start, greatest(r.s, m.region_start) AS a, least(r.e, m.region_end) AS b
       FROM runs r JOIN multi m ON m.meeting_id = r.meeting_id AND least(r.e, m.region_end) > greatest(r.s, m.region_start)),
    sig AS (SELECT conv_id, turn, run FROM piece WHERE b - a >= 250 GROUP BY ALL HAVING sum(b - a) >= 1200),
    who AS (SELECT DISTINCT p.conv_id, p.turn, p.run, v.speaker_id FROM piece p JOIN cover v USING (meeting_id, region_start) SEMI JOIN sig USING (conv_id, turn, run) WHERE p.b - p.a >= 250)
    SELECT conv_id, turn, spk AS speaker_id, s AS start_ms, e AS end_ms, text, false AS is_overlap FROM runs ANTI JOIN sig USING (conv_id, turn, run) WHERE e > s
    UNION ALL SELECT conv_id, turn, w.speaker_id, s, e, text, true FROM runs JOIN who w USING (conv_id, turn, run) WHERE e > s"""
