"""Keeping speaker names stable between passes, and the test for a second speaker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from parley.operators.intervals import clipped_edges
from parley.plans.kept import keep as kept
from parley.plans.slabs import SLAB_MS, side_by_side

# Fixed values of the clustering rule.
MIN_FRAMES, MIN_MEMBERS, MIN_SHARE = 160, 40, 0.22
MIN_GAP, GAP_TO_SPREAD, MIN_SPREAD, ROUNDS = 1.35, 2.2, 0.15, 15
SAME_VOICE, KEEP_OLD = 0.8, 0.6


def _take_best(pairs: DataFrame, new: str, old: str, score: str, tie: str) -> DataFrame:
    """Each new name, in order, takes the unused old name that scores best.

    Runs once per meeting over one row per (new, old) pair of names, never over turns or frames.
    """
    schema = T.StructType(
        [pairs.schema["meeting_id"], T.StructField(new, pairs.schema[new].dataType), T.StructField(old, T.StringType())]
    )

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict = {}
        for name, group in pdf.sort_values([new, score, tie], ascending=[True, False, True]).groupby(new, sort=True):
            free = group[~group[old].isin(taken.values())]
            if len(free):
                taken[name] = free[old].iloc[0]
        return pd.DataFrame(
            {"meeting_id": pdf["meeting_id"].iloc[0], new: list(taken), old: list(taken.values())}, columns=schema.names
        )

    return pairs.groupBy("meeting_id").applyInPandas(greedy, schema)


def _time_with_names(current: DataFrame, previous: DataFrame, bin_ms: int = SLAB_MS) -> DataFrame:
    """(meeting_id, new_id, old_id, interval_id, o0, ms): the time each old turn shares with all turns of a new name.

    No pairs of turns are formed, as these grow with the square of how many overlap.  Up to t a name has been heard
    sum(d * (t - edge)) over its edges in the bin; an old turn shares what that grows by from its start to its end.
    """
    timed = lambda df: df.where(F.col("meeting_id").isNotNull())
    cut = lambda df, extra: clipped_edges(df, ["meeting_id"], extra, bin_ms).drop("real")
    heard = cut(timed(current), ["new_id"])
    asked = timed(previous).select("meeting_id", F.col("speaker_id").alias("old_id"), "interval_id", F.col("start_ms").alias("o0"), "start_ms", "end_ms")
    asked = cut(asked, ["old_id", "interval_id", "o0"])
    names = heard.select("meeting_id", "_bin", "new_id").distinct()
    asked = side_by_side(asked, names, ["meeting_id", "_bin"])
    both = asked.withColumn("asked", F.lit(True)).unionByName(heard.withColumn("asked", F.lit(False)), allowMissingColumns=True)
    upto = W.partitionBy("meeting_id", "_bin", "new_id").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    step = F.when(~F.col("asked"), F.col("d"))
    so_far = F.coalesce(F.sum(step).over(upto) * F.col("t") - F.sum(step * F.col("t")).over(upto), F.lit(0))
    points = both.withColumn("_so_far", so_far).where("asked")
    # An end (d = -1) adds what had been heard up to it, a start takes that away.
    shared = points.groupBy("meeting_id", "new_id", "old_id", "interval_id", "o0").agg(F.sum(-F.col("d") * F.col("_so_far")).alias("ms"))
    return shared.where("ms > 0")


def _named_by_time(current: DataFrame, name: str, previous: DataFrame) -> DataFrame:
    """(meeting_id, new_id, old_id): new names with the old id whose single best old turn they overlap most."""
    per_turn = _time_with_names(current.withColumnRenamed(name, "new_id"), previous)
    best = per_turn.groupBy("meeting_id", "new_id", "old_id").agg(
        F.max("ms").alias("ms"), F.min(F.struct((-F.col("ms")).alias("neg"), "o0")).alias("first")
    ).withColumn("first_ms", F.col("first.o0")).drop("first")
    return _take_best(best, "new_id", "old_id", "ms", "first_ms")


def relabel_by_time(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Give new speaker ids the old id whose single best old turn they overlap most."""
    names = _named_by_time(current, "speaker_id", previous)
    return (
        current.join(names.withColumnRenamed("new_id", "speaker_id"), ["meeting_id", "speaker_id"], "left")
        .withColumn("speaker_id", F.coalesce("old_id", "speaker_id"))
        .drop("old_id")
    )


def _mean_vector(vector: str, dim: int) -> Column:
    return F.array(*[F.avg(F.col(vector)[i]) for i in range(dim)])


def centroids(frames: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """Mean vector per group; partial sums are combined map-side, vectors are never gathered."""
    return frames.groupBy(*by).agg(_mean_vector(vector, dim).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


def voice_similarity(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Cosine of every new cluster of a meeting with every speaker known in it: one row per pair of names."""
    k = known.select("meeting_id", F.col("speaker_id").alias("known_id"), F.col("centroid").alias("_known"))
    return fresh.join(k, "meeting_id").withColumn("similarity", cosine(F.col("centroid"), F.col("_known"))).drop("_known")


def relabel_by_voice(fresh: DataFrame, known: DataFrame, spans: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Known names for new clusters (meeting_id, label, centroid): by voice; else, with the clusters' spans (meeting_id,
    label, start_ms, end_ms) and the turns of the pass before, by the time they share with a name that is still unused;
    else the next free SPEAKER_nn."""
    pairs = voice_similarity(fresh, known).where(F.col("similarity") > SAME_VOICE).select(
        "meeting_id", "label", "known_id", "similarity"
    )
    named = _take_best(pairs, "label", "known_id", "similarity", "known_id")
    if spans is not None and previous is not None:
        left = spans.join(named.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti")
        unused = previous.join(named.select("meeting_id", F.col("known_id").alias("speaker_id")), ["meeting_id", "speaker_id"], "left_anti")
        by_time = _named_by_time(left, "label", unused)
        named = named.unionByName(by_time.select("meeting_id", F.col("new_id").alias("label"), F.col("old_id").alias("known_id")))
    used = known.select("meeting_id", F.col("speaker_id").alias("id")).union(named.select("meeting_id", "known_id"))
    taken = used.groupBy("meeting_id").agg(F.collect_set("id").alias("taken"))
    open_labels = fresh.select("meeting_id", "label").join(named, ["meeting_id", "label"], "left_anti")
    nth = open_labels.groupBy("meeting_id").agg(F.array_sort(F.collect_list("label")).alias("open"))
    nth = nth.join(taken, "meeting_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    numbers = F.sequence(F.lit(0), F.size("open") + F.size("taken"))
    free = F.filter(
        F.transform(numbers, lambda i: F.concat(F.lit("SPEAKER_"), F.lpad(i.cast("string"), 2, "0"))),
        lambda s: ~F.array_contains(F.col("taken"), s),
    )
    nth = nth.withColumn("free", F.slice(free, 1, F.size("open")))
    new = nth.select("meeting_id", F.inline(F.arrays_zip(F.col("open").alias("label"), F.col("free").alias("known_id"))))
    return fresh.join(named.unionByName(new), ["meeting_id", "label"]).withColumnRenamed("known_id", "speaker_id")


def blend_centroids(known: DataFrame, named: DataFrame) -> DataFrame:
    """Known voices after a pass: 0.6 old + 0.4 new, new speakers as they are."""
    n = named.select("meeting_id", "speaker_id", F.col("centroid").alias("_new"))
    mix = F.zip_with("centroid", "_new", lambda o, x: o * KEEP_OLD + x * (1 - KEEP_OLD))
    return known.join(n, ["meeting_id", "speaker_id"], "full").select(
        "meeting_id", "speaker_id", F.coalesce(mix, "_new", "centroid").alias("centroid")
    )


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def split_in_two(frames: DataFrame, dim: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Two-means for all meetings at once: (meeting_id, c0, c1), and the frames with their cluster.

    `frames` has meeting_id, pos, v.  Starts from the first frame and the one farthest from it, so
    that runs repeat.  A round is one map-side combined aggregation; the two centres per meeting
    are written to the checkpoint folder, and a round that moves nothing ends the loop.
    """
    first = frames.groupBy("meeting_id").agg(F.min_by("v", "pos").alias("c0"))
    far = frames.join(first, "meeting_id").groupBy("meeting_id", "c0").agg(
        F.max_by("v", F.struct(_distance2(F.col("v"), F.col("c0")), -F.col("pos"))).alias("c1")
    )
    centres = kept(far, "centres")

    def assign(c: DataFrame) -> DataFrame:
        nearer = _distance2(F.col("v"), F.col("c1")) < _distance2(F.col("v"), F.col("c0"))
        return frames.join(c, "meeting_id").withColumn("cluster", nearer.cast("int"))

    for _ in range(rounds):
        mean = [
            F.array(*[F.avg(F.when(F.col("cluster") == k, F.col("v")[i])) for i in range(dim)]).alias(f"m{k}") for k in (0, 1)
        ]
        moved = assign(centres).groupBy("meeting_id", "c0", "c1").agg(*mean)
        keep = lambda m, c: F.when(F.col(m)[0].isNull(), F.col(c)).otherwise(F.col(m))
        moved = kept(moved.select(
            "meeting_id", keep("m0", "c0").alias("c0"), keep("m1", "c1").alias("c1"),
            ((F.col("c0") != keep("m0", "c0")) | (F.col("c1") != keep("m1", "c1"))).alias("moved"),
        ), "centres")
        centres = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return centres, assign(centres)


def count_speakers(frames: DataFrame, dim: int, max_speakers: int = 2) -> DataFrame:
    """One speaker per meeting unless the two-way split is large, wide and tight enough."""
    centres, split = split_in_two(frames, dim)
    own = F.when(F.col("cluster") == 1, F.col("c1")).otherwise(F.col("c0"))
    stats = split.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cluster").alias("n1"),
        F.avg(_distance2(F.col("v"), own)).alias("spread"),
        F.sqrt(F.max(_distance2(F.col("c0"), F.col("c1")))).alias("gap"),
    )
    least = F.least(F.col("n1"), F.col("n") - F.col("n1"))
    two = (
        F.lit(max_speakers >= 2)
        & (F.col("n") >= MIN_FRAMES)
        & (least >= F.greatest(F.lit(MIN_MEMBERS), F.floor(F.col("n") * F.lit(MIN_SHARE))))
        & (F.col("gap") >= MIN_GAP)
        & (F.col("gap") >= F.greatest("spread", F.lit(MIN_SPREAD)) * GAP_TO_SPREAD)
    )
    return stats.select("meeting_id", "n", "n1", "gap", "spread", F.when(two, 2).otherwise(1).alias("n_speakers"))
