"""Registered queries over speaker turns, with their SQL."""

from pyspark.sql import functions as F

from parley.catalog.common import INTERVALS, WINDOWS
from parley.operators import intervals as iv
from parley.sources import adapters as src

WIN = ["meeting_id", "conv_id", "turn"]


def j1(spark, d):
    w = src.stt_windows(spark, d).select(*WIN, F.col("start_ms").alias("w0"), F.col("end_ms").alias("w1"))
    i = src.intervals(spark, d).select("meeting_id", "interval_id", "start_ms", "end_ms")
    return iv.overlap_join(w, i, ["meeting_id"], ("w0", "w1"), ("start_ms", "end_ms")).select(
        "conv_id", "turn", "interval_id", "overlap_ms"
    )


def j2(spark, d):
    """Speakers at the middle of every speaker turn."""
    i = src.intervals(spark, d)
    p = i.select("meeting_id", F.col("interval_id").alias("point_id"),
                 F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))
    return (
        iv.speakers_at(p, i, "at_ms", ["meeting_id", "point_id"])
        .groupBy("point_id", "at_ms")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "speaker_id"))),
                                      lambda x: x["speaker_id"]), ",").alias("speakers"))
    )


def j3(spark, d):
    return iv.dominant_speaker(src.stt_windows(spark, d), src.intervals(spark, d), WIN).select(
        "conv_id", "turn", "speaker_id", "overlap_ms"
    )


def j4(spark, d):
    return iv.mark_overlaps(src.intervals(spark, d), ["meeting_id"]).select("interval_id", "is_overlap")


def w3(spark, d):
    return iv.atomic_regions(src.intervals(spark, d), ["meeting_id"])


def w3_named(spark, d):
    i = src.intervals(spark, d)
    r = iv.atomic_regions(i, ["meeting_id"]).where("n_speakers > 0").withColumn(
        "mid", F.floor((F.col("region_start") + F.col("region_end")) / 2)
    )
    ids = ["meeting_id", "region_start", "region_end"]
    return (
        iv.heard_at(r, i, "mid", ids)
        .groupBy(*ids)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "speaker_id"))),
                                      lambda x: x["speaker_id"]), ",").alias("speakers"))
    )


def w4(spark, d):
    i = src.intervals(spark, d)
    return iv.significant_overlap(i, iv.shared_regions(i, named_from_ms=iv.MIN_REGION_MS), ["meeting_id", "interval_id"]).select(
        "interval_id", "shared_ms", "ov_start", "ov_end", F.array_join("speakers", ",").alias("speakers")
    )


def w5(spark, d):
    marked = iv.mark_overlaps(src.intervals(spark, d), ["meeting_id"])
    return iv.merge_speaker_turns(marked, ["meeting_id"])


def w7(spark, d):
    """Spans counted in 16 kHz samples, joined over gaps of up to 80 ms."""
    s = src.intervals(spark, d).select(
        "meeting_id", "speaker_id", F.col("interval_id").alias("span_id"),
        (F.col("start_ms").cast("long") * 16).alias("s"), (F.col("end_ms").cast("long") * 16).alias("e"))
    out = iv.spans_to_intervals(s, ["meeting_id", "speaker_id"], 1280, 16 * 600_000)
    return out.select("meeting_id", "speaker_id", F.floor(F.col("s") * 1000 / 16000).alias("start_ms"),
                      F.floor(F.col("e") * 1000 / 16000).alias("end_ms"), "n_spans")


def w8(spark, d):
    f = src.speech_frames(spark, d).select("meeting_id", (F.col("frame_idx") * 240).alias("pos"),
                                           F.col("stream_id").alias("label"))
    return iv.label_runs(f, ["meeting_id"], "pos", "label", 480, 240 * 50_000)


QUERIES = {
    "j1_overlap_join": j1,
    "j2_speakers_at": j2,
    "j3_dominant_speaker": j3,
    "j4_mark_overlaps": j4,
    "w3_atomic_regions": w3,
    "w3_region_speakers": w3_named,
    "w4_significant_overlap": w4,
    "w5_merge_turns": w5,
    "w7_spans_to_intervals": w7,
    "w8_label_runs": w8,
}

REGIONS = """
edges AS (SELECT DISTINCT meeting_id, t FROM (
    SELECT meeting_id, start_ms AS t FROM intervals WHERE start_ms < end_ms
    UNION ALL SELECT meeting_id, end_ms FROM intervals WHERE start_ms < end_ms)),
cuts AS (SELECT meeting_id, t AS region_start, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS region_end FROM edges),
cover AS (
  SELECT c.meeting_id, c.region_start, c.region_end, i.speaker_id,
         min((i.start_ms, i.end_ms, i.speaker_id, i.interval_id)) AS ord
  FROM cuts c JOIN intervals i ON i.meeting_id = c.meeting_id
    AND i.start_ms <= (c.region_start + c.region_end) // 2 AND (c.region_start + c.region_end) // 2 < i.end_ms
  WHERE c.region_end IS NOT NULL GROUP BY ALL),
regions AS (
  SELECT c.meeting_id, c.region_start, c.region_end, CAST(count(v.speaker_id) AS BIGINT) AS n_speakers
  FROM cuts c LEFT JOIN cover v USING (meeting_id, region_start, region_end)
  WHERE c.region_end IS NOT NULL GROUP BY ALL)"""

MARKED = """
marked AS (
  SELECT a.*, EXISTS (SELECT 1 FROM intervals b WHERE b.meeting_id = a.meeting_id AND b.speaker_id <> a.speaker_id
    AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)) AS is_overlap
  FROM intervals a)"""

SQL = {
    "j1_overlap_join": f"""WITH {INTERVALS}, {WINDOWS}
        SELECT w.conv_id, w.turn, i.interval_id,
               least(w.end_ms, i.end_ms) - greatest(w.start_ms, i.start_ms) AS overlap_ms
        FROM stt_windows w JOIN intervals i ON i.meeting_id = w.meeting_id
         AND least(w.end_ms, i.end_ms) > greatest(w.start_ms, i.start_ms)""",
    "j2_speakers_at": f"""WITH {INTERVALS}, p AS (
          SELECT meeting_id, interval_id AS point_id, (start_ms + end_ms) // 2 AS at_ms FROM intervals),
        hit AS (SELECT point_id, at_ms, i.speaker_id, min((i.start_ms, i.end_ms, i.speaker_id, i.interval_id)) AS ord
          FROM p JOIN intervals i ON i.meeting_id = p.meeting_id AND i.start_ms <= at_ms AND at_ms < i.end_ms GROUP BY ALL)
        SELECT point_id, at_ms, string_agg(speaker_id, ',' ORDER BY ord) AS speakers FROM hit GROUP BY ALL""",
    "j3_dominant_speaker": f"""WITH {INTERVALS}, {WINDOWS}, ov AS (
          SELECT w.conv_id, w.turn, i.speaker_id,
                 sum(least(w.end_ms, i.end_ms) - greatest(w.start_ms, i.start_ms)) AS ov,
                 min((i.start_ms, i.end_ms, i.speaker_id, i.interval_id)) AS ord
          FROM stt_windows w JOIN intervals i ON i.meeting_id = w.meeting_id
           AND least(w.end_ms, i.end_ms) > greatest(w.start_ms, i.start_ms) GROUP BY ALL),
        best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY ov DESC, ord) = 1)
        SELECT w.conv_id, w.turn, coalesce(b.speaker_id, 'SPEAKER_00') AS speaker_id,
               CAST(coalesce(b.ov, 0) AS BIGINT) AS overlap_ms
        FROM stt_windows w LEFT JOIN best b USING (conv_id, turn)""",
    "j4_mark_overlaps": f"WITH {INTERVALS}, {MARKED} SELECT interval_id, is_overlap FROM marked",
    "w3_atomic_regions": f"WITH {INTERVALS}, {REGIONS} SELECT * FROM regions",
    "w3_region_speakers": f"""WITH {INTERVALS}, {REGIONS}
        SELECT meeting_id, region_start, region_end, string_agg(speaker_id, ',' ORDER BY ord) AS speakers
        FROM cover GROUP BY ALL""",
    "w4_significant_overlap": f"""WITH {INTERVALS}, {REGIONS}, multi AS (SELECT * FROM regions WHERE n_speakers >= 2),
        piece AS (SELECT w.interval_id, m.meeting_id, m.region_start, greatest(w.start_ms, m.region_start) AS a,
                  least(w.end_ms, m.region_end) AS b
          FROM intervals w JOIN multi m ON m.meeting_id = w.meeting_id
           AND least(w.end_ms, m.region_end) > greatest(w.start_ms, m.region_start)),
        hits AS (SELECT interval_id, sum(CASE WHEN b - a >= 250 THEN b - a END) AS shared_ms,
                 min(a) AS ov_start, max(b) AS ov_end FROM piece GROUP BY ALL HAVING shared_ms >= 1200),
        people AS (SELECT p.interval_id, v.speaker_id, min((p.region_start, v.ord)) AS seen
          FROM piece p JOIN cover v USING (meeting_id, region_start) WHERE p.b - p.a >= 250 GROUP BY ALL)
        SELECT h.interval_id, CAST(h.shared_ms AS BIGINT) AS shared_ms, h.ov_start, h.ov_end,
               string_agg(p.speaker_id, ',' ORDER BY p.seen, p.speaker_id) AS speakers
        FROM hits h JOIN people p USING (interval_id) GROUP BY ALL""",
    "w5_merge_turns": f"""WITH {INTERVALS}, {MARKED}, b AS (
          SELECT *, CASE WHEN is_overlap OR coalesce(lag(is_overlap) OVER w, false) THEN 1 ELSE 0 END AS cut
          FROM marked WINDOW w AS (PARTITION BY meeting_id, speaker_id ORDER BY start_ms, end_ms, interval_id)),
        b2 AS (SELECT *, sum(cut) OVER (PARTITION BY meeting_id, speaker_id ORDER BY start_ms, end_ms, interval_id) AS block FROM b),
        r AS (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id, speaker_id, block ORDER BY start_ms, end_ms, interval_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b2),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 400 THEN 1 ELSE 0 END)
               OVER (PARTITION BY meeting_id, speaker_id, block ORDER BY start_ms, end_ms, interval_id) AS island FROM r)
        SELECT meeting_id, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, bool_or(is_overlap) AS is_overlap,
               count(*) AS n_turns
        FROM g GROUP BY meeting_id, speaker_id, block, island""",
    "w7_spans_to_intervals": f"""WITH {INTERVALS}, s AS (SELECT meeting_id, speaker_id, interval_id, start_ms * 16 AS s, end_ms * 16 AS e FROM intervals),
        r AS (SELECT *, max(e) OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e, interval_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1280 THEN 1 ELSE 0 END)
               OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e, interval_id) AS island FROM r)
        SELECT meeting_id, speaker_id, (min(s) * 1000) // 16000 AS start_ms, (max(e) * 1000) // 16000 AS end_ms, count(*) AS n_spans
        FROM g GROUP BY meeting_id, speaker_id, island""",
    "w8_label_runs": """WITH f AS (
          SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_type AS label,
                 (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 240 AS pos FROM events),
        h AS (SELECT *, lag(label) OVER (PARTITION BY meeting_id ORDER BY pos) AS prev, max(pos) OVER (PARTITION BY meeting_id) + 480 AS last_end FROM f)
        SELECT meeting_id, label, pos AS run_start, coalesce(lead(pos) OVER (PARTITION BY meeting_id ORDER BY pos), last_end) AS run_end
        FROM h WHERE prev IS NULL OR prev <> label""",
}
