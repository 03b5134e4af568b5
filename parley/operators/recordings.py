"""From the windows of recordings to reviewed segments, for all meetings in one job.

Where nobody is heard for longer than any rule looks back, nothing before can matter after: a meeting falls into
islands, and each is aligned, deduped and merged on its own.  Windows and turns are written once in buckets of their
island, so that the steps between read them side by side.  Every stage is a written table, so plans stay short and a
lost executor repeats no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.operators import intervals as iv, reconcile as rc, review as rv
from parley.plans.kept import keep, keep_by
from parley.plans.slabs import Run, running, slab_of

#: The longest pause that a fold looks across: twins are looked for up to 4 s back.
PAUSE_MS = 4000


def with_islands(windows: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Adds `island`, the start of the first window that follows a longer pause in the meeting."""
    order = ["start_ms", "end_ms", "window_id"]
    slabbed = windows.withColumn("_slab", slab_of(F.col("start_ms")))
    reach = running(slabbed, ["meeting_id"], "_slab", order, [Run("_reach", "max", F.col("end_ms").cast("long"), inclusive=False)])
    start = F.col("start_ms").cast("long")
    reach = reach.withColumn("_own", F.when(F.col("_reach").isNull() | (start > F.col("_reach") + pause_ms), start))
    known = running(reach, ["meeting_id"], "_slab", order, [Run("_last", "last", F.col("_own"))])
    return known.withColumn("island", F.coalesce("_own", "_last")).drop("_slab", "_reach", "_own", "_last")


def by_island(windows: DataFrame, turns: DataFrame, pause_ms: int = PAUSE_MS) -> tuple[DataFrame, DataFrame]:
    """Windows and turns under the name of their island: meeting_id becomes that name, `recording` is the meeting.

    A turn is given to every island it shares time with; it keeps its own times, which decide who was heard first.
    """
    name = F.concat_ws("\x1f", "meeting_id", "island")
    cut = keep(with_islands(windows, pause_ms), "islands")
    spans = cut.groupBy("meeting_id", "island").agg(F.min("start_ms").alias("i_start"), F.max("end_ms").alias("i_end"))
    met = iv.overlap_join(spans, turns, ["meeting_id"], ("i_start", "i_end"), ("start_ms", "end_ms"))
    own_turns = met.select(name.alias("meeting_id"), F.col("meeting_id").alias("recording"), "speaker_id", "start_ms", "end_ms", "is_overlap", "interval_id")
    own_windows = cut.select(name.alias("meeting_id"), F.col("meeting_id").alias("recording"), *[c for c in windows.columns if c != "meeting_id"])
    return keep_by(own_windows, ["meeting_id"], "windows"), keep_by(own_turns, ["meeting_id"], "turns")


def to_segments(windows: DataFrame, turns: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """meeting_id and the columns of a segment: windows laid on the speakers of their meeting, variants and hops joined.

    `windows` has meeting_id, start_ms, end_ms, text, words and window_id; `turns` speaker_id, start_ms, end_ms,
    is_overlap and interval_id.
    """
    own_windows, own_turns = by_island(windows, turns, pause_ms)
    keys = ["meeting_id", "recording"]
    aligned = rc.align_windows(own_windows, own_turns, keys)
    found = rc.dedupe_segments(aligned, keys)
    return found.drop("meeting_id").withColumnRenamed("recording", "meeting_id")


def reviewed(windows: DataFrame, turns: DataFrame, reviewer: rv.Reviewer | None, language: str = "en") -> DataFrame:
    """Gated windows to reviewed segments."""
    gated = keep(rv.gate_segments(windows, language), "gated")
    segments = keep(to_segments(gated, turns), "segments").withColumn("ord", F.struct("start_ms", "speaker_id", "text"))
    return rv.finalize_review(segments, reviewer, language)
