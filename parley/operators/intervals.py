"""Interval algebra on half-open [start_ms, end_ms) spans, all meetings at once.

Joins are equi-joins on (meeting, time bin), so a hot meeting spreads over its
bins; sweeps use slab-wise running sums and never build pairs of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.plans.carry import dealt
from parley.plans.kept import keep
from parley.plans.slabs import SLAB_MS, Run, islands, running, side_by_side, slab_of

BIN_MS = 120_000
#: Shared time shorter than this is no overlap of speakers.
MIN_REGION_MS = 250
DEFAULT_SPEAKER = "SPEAKER_00"


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins touched by [start, end); an empty span touches the bin of its start."""
    return F.sequence(
        F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Pairs of rows with equal keys and a positive overlap, each pair once.

    Both sides are spread over the time bins they touch; the pair is kept in
    the later of the two first bins only, so no distinct is needed.
    """
    l0, l1 = left_span
    r0, r1 = right_span
    lb = left.withColumn("_bin", F.explode(_bins(F.col(l0), F.col(l1), bin_ms)))
    rb = right.withColumn("_bin", F.explode(_bins(F.col(r0), F.col(r1), bin_ms)))
    return (
        side_by_side(lb, rb, [*keys, "_bin"])
        .where((F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1)))
        .where((F.col(l0) < F.col(l1)) & (F.col(r0) < F.col(r1)))
        .where(F.col("_bin") == F.floor(F.greatest(l0, r0) / bin_ms))
        .drop("_bin")
        .withColumn(
            "overlap_ms", F.least(l1, r1) - F.greatest(l0, r0)
        )
    )


def leading_spans(intervals: DataFrame, slab_ms: int = SLAB_MS) -> DataFrame:
    """The turns with the time [lead_start, lead_end) in which each is its speaker's first one still heard.

    Of a speaker's turns by (start, end, id) that is the time from the largest end before a turn on, so these spans of a
    speaker share no time, however many of the turns do; turns that never lead are left out.
    """
    live = intervals.where(F.col("start_ms") < F.col("end_ms")).select(
        "meeting_id", "speaker_id", "start_ms", "end_ms", "interval_id", slab_of(F.col("start_ms"), slab_ms).alias("_slab")
    )
    reach = Run("_reach", "max", F.col("end_ms").cast("long"), inclusive=False)
    led = running(live, ["meeting_id", "speaker_id"], "_slab", ["start_ms", "end_ms", "interval_id"], [reach])
    start = F.greatest(F.col("start_ms").cast("long"), F.col("_reach"))
    led = led.withColumn("lead_start", start).withColumn("lead_end", F.col("end_ms").cast("long"))
    return led.where("lead_start < lead_end").drop("_slab", "_reach")


def heard_at(points: DataFrame, intervals: DataFrame, point: str, ids: list[str], bin_ms: int = BIN_MS) -> DataFrame:
    """One row for each row of `points` and speaker covering it, with the first covering turn as `ord`."""
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_ms))
    led = leading_spans(intervals).withColumn("_bin", F.explode(_bins(F.col("lead_start"), F.col("lead_end"), bin_ms)))
    ord = F.struct("start_ms", "end_ms", "speaker_id", "interval_id")
    led = led.select("meeting_id", "_bin", "speaker_id", "lead_start", "lead_end", ord.alias("ord"))
    p = p.select("meeting_id", *[c for c in ids if c != "meeting_id"], point, "_bin")
    return side_by_side(p, led, ["meeting_id", "_bin"]).where((F.col("lead_start") <= F.col(point)) & (F.col(point) < F.col("lead_end"))).select(
        *dict.fromkeys([*ids, point]), "speaker_id", "ord"
    )


def speakers_at(
    points: DataFrame, intervals: DataFrame, point: str, ids: list[str], bin_ms: int = BIN_MS
) -> DataFrame:
    """Distinct speakers covering each point, in interval order, one row per (point, speaker)."""
    hit = heard_at(points, intervals, point, ids, bin_ms)
    return hit.groupBy(*ids, point, "speaker_id").agg(F.min("ord").alias("ord"))


def dominant_speaker(
    windows: DataFrame, intervals: DataFrame, ids: list[str], bin_ms: int = BIN_MS
) -> DataFrame:
    """Speaker with the most overlap per window; ties go to the one heard first."""
    w = windows.select(
        *ids, F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end")
    )
    iv = intervals.select(
        "meeting_id", "speaker_id", "start_ms", "end_ms", "interval_id"
    )
    per_speaker = (
        overlap_join(w, iv, ["meeting_id"], ("w_start", "w_end"), ("start_ms", "end_ms"), bin_ms)
        .groupBy(*ids, "speaker_id")
        .agg(
            F.sum("overlap_ms").alias("ov"),
            F.min(F.struct("start_ms", "end_ms", "speaker_id", "interval_id")).alias("ord"),
        )
    )
    # Windows without any hit enter the same aggregation, so no outer join is needed.
    none = windows.select(
        *ids, F.lit(None).cast("string").alias("speaker_id"), F.lit(0).cast("long").alias("ov"),
    )
    all_rows = per_speaker.unionByName(none, allowMissingColumns=True)
    best = all_rows.groupBy(*ids).agg(
        F.max("ov").alias("overlap_ms"),
        F.min(F.struct((-F.col("ov")).alias("neg"), "ord", "speaker_id")).alias("top"),
    )
    return best.select(
        *ids,
        F.when(F.col("overlap_ms") > 0, F.col("top.speaker_id"))
        .otherwise(F.lit(DEFAULT_SPEAKER))
        .alias("speaker_id"),
        "overlap_ms",
    )


# ---- sweeps -----------------------------------------------------------------
#
# Turns are spread over the time bins they touch and clipped to them, so every
# (meeting, bin) knows on its own who is heard in it.  One shuffle brings a bin
# together; all windows below run inside it, and bins of a hot meeting run apart.


def clipped_edges(intervals: DataFrame, keys: list[str], extra: list[str], bin_ms: int = SLAB_MS) -> DataFrame:
    """Starts (d = 1) and ends (d = -1) of the turns, clipped to the bins they touch.

    `real` is false where a bin cut the turn.  A (key, bin) comes together in one partition; there are as many of these
    as a shuffle has, as edges are few bytes when shuffled and far more in the windows that sort them.
    """
    live = intervals.where(F.col("start_ms") < F.col("end_ms")).withColumn(
        "_bin", F.explode(_bins(F.col("start_ms"), F.col("end_ms"), bin_ms))
    )
    lo, hi = F.col("_bin") * bin_ms, (F.col("_bin") + 1) * bin_ms
    start, end = F.col("start_ms").cast("long"), F.col("end_ms").cast("long")
    edges = live.select(
        *keys,
        *dict.fromkeys(extra),
        "_bin",
        F.inline(
            F.array(
                F.struct(F.greatest(start, lo).alias("t"), F.lit(1).alias("d"), (start >= lo).alias("real")),
                F.struct(F.least(end, hi).alias("t"), F.lit(-1).alias("d"), (end <= hi).alias("real")),
            )
        ),
    )
    return dealt(edges, *keys, "_bin")


def sweep(
    intervals: DataFrame, keys: list[str], extra: list[str], who: str = "speaker_id", bin_ms: int = SLAB_MS
) -> DataFrame:
    """Edges of the clipped turns with `n_speakers`, the number of different `who` heard from t on."""
    edges = clipped_edges(intervals, keys, [who, *extra], bin_ms)
    one = W.partitionBy(*keys, "_bin", who).orderBy("t")
    now = F.sum("d").over(one.rangeBetween(W.unboundedPreceding, 0))
    was = F.coalesce(F.sum("d").over(one.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(W.partitionBy(*keys, "_bin", who, "t").orderBy("d")) == 1
    step = F.when(first & (now > 0) & (was <= 0), 1).when(first & (now <= 0) & (was > 0), -1).otherwise(0)
    return edges.withColumn("step", step).withColumn(
        "n_speakers",
        F.sum("step").over(W.partitionBy(*keys, "_bin").orderBy("t").rangeBetween(W.unboundedPreceding, 0)),
    )


def atomic_regions(intervals: DataFrame, keys: list[str], bin_ms: int = SLAB_MS) -> DataFrame:
    """Time between neighbouring interval edges with the number of speakers heard in it."""
    # An instant on a bin edge shows up in both bins: the later one knows who goes on.
    edges = (
        sweep(intervals, keys, [], bin_ms=bin_ms)
        .groupBy(*keys, slab_of(F.col("t"), bin_ms).alias("_slab"), "t")
        .agg(F.max_by("n_speakers", "_bin").alias("n_speakers"), F.max("real").alias("real"))
        .where("real")
    )
    swept = running(edges, keys, "_slab", ["t"], [Run("region_end", "next", F.col("t"))])
    return swept.where(F.col("region_end").isNotNull()).select(
        *keys, F.col("t").alias("region_start"), "region_end", "n_speakers"
    )


def mark_overlaps(
    intervals: DataFrame, keys: list[str], id_col: str = "interval_id", bin_ms: int = SLAB_MS
) -> DataFrame:
    """Flag intervals during which some other speaker is heard too.

    With M(t) = time before t shared by two or more speakers, an interval is
    flagged iff M(end) > M(start); the differences add up over its bins.
    """
    edges = sweep(intervals, keys, [id_col], bin_ms=bin_ms)
    in_bin = W.partitionBy(*keys, "_bin").orderBy("t")
    ahead = F.lead("t").over(W.partitionBy(*keys, "_bin").orderBy("t", "d", id_col)) - F.col("t")
    marks = (
        edges.withColumn("multi", F.when(F.col("n_speakers") >= 2, F.coalesce(ahead, F.lit(0))).otherwise(0))
        .withColumn("m", F.coalesce(F.sum("multi").over(in_bin.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .groupBy(*keys, id_col)
        .agg(F.sum(F.col("m") * -F.col("d")).alias("shared_ms"))
    )
    return (
        side_by_side(intervals.drop("is_overlap"), marks, [*keys, id_col], "left")
        .withColumn("shared_ms", F.coalesce("shared_ms", F.lit(0)))
        .withColumn("is_overlap", F.col("shared_ms") > 0)
    )


def shared_regions(intervals: DataFrame, bin_ms: int = BIN_MS, named_from_ms: int = 0) -> DataFrame:
    """Atomic regions with two or more speakers, with the speakers in interval order.

    The denser turns lie, the more regions there are, and most are short: those shorter than `named_from_ms` get no
    list of speakers (null).  The regions are written, as they are read several times.
    """
    ids = ["meeting_id", "region_start", "region_end"]
    regions = keep(atomic_regions(intervals, ["meeting_id"]).where("n_speakers >= 2").select(*ids), "regions")
    lasts = F.col("region_end") - F.col("region_start") >= named_from_ms
    # Regions are named once each, so their speakers are met once each.
    named = heard_at(
        regions.where(lasts).withColumn("mid", F.floor((F.col("region_start") + F.col("region_end")) / 2)), intervals, "mid", ids, bin_ms
    )
    in_order = F.array_sort(F.collect_list(F.struct("ord", "speaker_id")))
    named = named.groupBy(*ids).agg(F.transform(in_order, lambda x: x["speaker_id"]).alias("region_speakers"))
    brief = regions.where(~lasts & F.col("meeting_id").isNotNull())
    return keep(named.unionByName(brief, allowMissingColumns=True), "shared")


def _heard_next(big: DataFrame) -> DataFrame:
    """For each of these regions and each speaker of its bin who is still to be heard there: the next region with that
    speaker, which may be the region itself.

    `big` numbers the regions of a (meeting_id, _bin) as `_k`.
    """
    heard = big.select("meeting_id", "_bin", "_k", "region_start", "region_end", F.posexplode("region_speakers").alias("pos", "speaker_id"))
    one = W.partitionBy("meeting_id", "_bin", "speaker_id").orderBy("_k")
    heard = heard.withColumn("_first", F.lag("_k", 1, 0).over(one) + 1)
    heard = heard.withColumn("_k", F.explode(F.sequence("_first", "_k")))
    return heard.select("meeting_id", "_bin", "_k", "speaker_id", "region_start", "region_end", "pos")


def significant_overlap(
    windows: DataFrame,
    regions: DataFrame,
    ids: list[str],
    min_overlap_ms: int = 1200,
    min_region_ms: int = MIN_REGION_MS,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Windows in which speakers truly share time, with the speakers in order of appearance.

    `regions` are the `shared_regions` of the turns, named from `min_region_ms` on.  Also gives the outer edge of the
    shared time (any shared piece, however short).

    No pairs of windows and regions are formed.  Regions share no time, so what a window holds is the difference of
    running sums at its edges, but for the regions that lie across an edge; and a window meets a speaker at the first
    region from its start on in which that speaker is heard, once for each bin it touches.
    """
    min_region_ms = max(1, min_region_ms)  # what only touches shares no time
    start, end = F.col("region_start"), F.col("region_end")
    big = end - start >= min_region_ms
    shared = regions.where(F.col("meeting_id").isNotNull()).withColumn("_bin", F.floor(start / bin_ms))
    count = F.sum(big.cast("int")).over(W.partitionBy("meeting_id", "_bin").orderBy("region_start"))
    shared = shared.withColumn("_k", F.when(big, count))

    w = windows.select(*ids, F.col("start_ms").cast("long").alias("w_start"), F.col("end_ms").cast("long").alias("w_end"))
    w = w.where((F.col("w_start") < F.col("w_end")) & F.col("meeting_id").isNotNull())
    edge = lambda c, no: F.struct(F.col(c).alias("_at"), F.lit(no).alias("_edge"))
    edges = w.select("*", F.inline(F.array(edge("w_start", 0), edge("w_end", 1))))
    # Regions come after the edges of the same time, so that the last one before an edge begins before it.
    spans = shared.select("meeting_id", start.alias("_at"), F.lit(2).alias("_edge"), "region_start", "region_end", "_bin", "_k")
    line = edges.unionByName(spans, allowMissingColumns=True).withColumn("_slab", slab_of(F.col("_at")))
    region, place = F.col("_edge") == 2, F.struct("region_start", "region_end", "_bin", "_k")
    line = running(
        line, ["meeting_id"], "_slab", ["_at", "_edge"],
        [
            Run("_sum", "sum", F.coalesce(F.when(F.col("_k").isNotNull(), end - start), F.lit(0))),
            Run("_last", "last", F.when(region, place)),
            Run("_next", "next", F.when(region, start)),
            Run("_big", "next", F.when(F.col("_k").isNotNull(), place)),
        ],
    )
    line = keep(line.where(~region).select(*ids, "w_start", "w_end", "_edge", "_sum", "_last", "_next", "_big"), "edges")

    w0, w1, r0, r1 = F.col("w_start"), F.col("w_end"), F.col("_last.region_start"), F.col("_last.region_end")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # The region across the start, and what of it lies in the window; none of it counts in a running sum.
    head = F.when(r1 > w0, F.least(r1, w1) - w0)
    counts = zero(head) >= min_region_ms
    opening = zero(F.when(counts, head)) - F.col("_sum") + zero(F.when((r1 > w1) & F.col("_last._k").isNotNull(), r1 - r0))
    tail = F.when((r1 > w1) & (r0 >= w0) & (w1 - r0 >= min_region_ms), w1 - r0)
    closing = zero(tail) + F.col("_sum") - zero(F.when((r1 > w1) & F.col("_last._k").isNotNull(), r1 - r0))
    starts = F.col("_edge") == 0
    times = line.select(
        *ids,
        F.lit(False).alias("_named"),
        F.when(starts, opening).otherwise(closing).alias("ms"),
        F.when(starts, F.when(r1 > w0, w0).when(F.col("_next") < w1, F.col("_next"))).alias("a"),
        F.when(~starts & (r1 > w0), F.least(r1, w1)).alias("b"),
    )
    # Speakers are looked up at the first long region of the window, and at the first one of each later bin.
    asks = line.where(starts).withColumn("_from", F.when(head.isNotNull() & counts, F.col("_last")).otherwise(F.col("_big")))
    asks = asks.where(F.least(F.col("_from.region_end"), w1) - F.greatest(F.col("_from.region_start"), w0) >= min_region_ms)
    till = F.floor((w1 - 1) / bin_ms)
    later = F.when(till > F.col("_from._bin"), F.sequence(F.col("_from._bin") + 1, till)).otherwise(F.array().cast("array<bigint>"))
    at = lambda b, k: F.struct(b.alias("_bin"), k.cast("bigint").alias("_k"))
    places = F.concat(F.array(at(F.col("_from._bin"), F.col("_from._k"))), F.transform(later, lambda b: at(b, F.lit(1))))
    asks = asks.select(*ids, "w_start", "w_end", F.inline(places))
    met = side_by_side(asks, _heard_next(shared.where(F.col("_k").isNotNull())), ["meeting_id", "_bin", "_k"])
    people = met.where(F.least(end, w1) - F.greatest(start, w0) >= min_region_ms).select(
        *ids, F.lit(True).alias("_named"), "speaker_id", F.struct("region_start", "pos").alias("seen")
    )
    per_speaker = times.unionByName(people, allowMissingColumns=True).groupBy(*ids, "_named", "speaker_id").agg(
        F.sum("ms").alias("ms"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("seen").alias("seen")
    )
    seen = F.collect_list(F.when(F.col("_named"), F.struct("seen", "speaker_id")))
    return (
        per_speaker.groupBy(*ids)
        .agg(
            F.sum("ms").alias("shared_ms"),
            F.min("a").alias("ov_start"),
            F.max("b").alias("ov_end"),
            F.transform(F.array_sort(seen), lambda x: x["speaker_id"]).alias("speakers"),
        )
        .where((F.col("shared_ms") >= min_overlap_ms) & F.col("ov_start").isNotNull())
    )


def merge_speaker_turns(
    intervals: DataFrame, keys: list[str], gap_ms: int = 400, slab_ms: int = SLAB_MS
) -> DataFrame:
    """Join a speaker's neighbouring turns; turns flagged as overlap always stand alone."""
    by = [*keys, "speaker_id"]
    order = ["start_ms", "end_ms", "interval_id"]
    s = intervals.withColumn("_slab", slab_of(F.col("start_ms"), slab_ms))
    # A flagged turn breaks the chain: the turns behind it name it as their block.
    flagged = F.when(F.col("is_overlap"), F.struct(*order))
    blocks = running(s, by, "_slab", order, [Run("_block", "last", flagged)])
    own = F.coalesce("is_overlap", F.lit(False))
    alone = blocks.where(own).select(
        *by, F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.lit(True).alias("is_overlap"), F.lit(1).cast("long").alias("n_turns")
    )
    chains = islands(
        blocks.where(~own), [*by, "_block"], "_slab", order, "start_ms", "end_ms", gap_ms
    ).select(*by, "start_ms", "end_ms", F.lit(False).alias("is_overlap"), F.col("n_rows").alias("n_turns"))
    return alone.unionByName(chains)


def spans_to_intervals(
    spans: DataFrame, keys: list[str], max_gap: int, slab: int, start: str = "s", end: str = "e"
) -> DataFrame:
    """Islands of sample spans per key; `max_gap` and `slab` are in samples."""
    s = spans.withColumn("_slab", slab_of(F.col(start), slab))
    return islands(s, keys, "_slab", [start, end, "span_id"], start, end, max_gap).withColumnRenamed(
        "n_rows", "n_spans"
    )


def label_runs(
    frames: DataFrame, keys: list[str], pos: str, label: str, frame_len: int, slab: int
) -> DataFrame:
    """Runs of equal labels as abutting turns: a run ends where the next one starts."""
    s = frames.withColumn("_slab", slab_of(F.col(pos), slab))
    prev = running(s, keys, "_slab", [pos], [Run("_prev", "last", F.col(label))])
    heads = prev.where(F.col("_prev").isNull() | (F.col("_prev") != F.col(label))).drop("_prev")
    heads = running(heads, keys, "_slab", [pos], [Run("_end", "next", F.col(pos))])
    last = frames.groupBy(*keys).agg((F.max(pos) + frame_len).alias("_last"))
    return side_by_side(heads, last, keys).select(
        *keys,
        F.col(label),
        F.col(pos).alias("run_start"),
        F.coalesce("_end", "_last").alias("run_end"),
    ).where("run_end > run_start")
