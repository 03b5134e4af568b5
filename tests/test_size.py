"""Steps whose cost must not grow faster than their input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import hooks
from parley.operators import intervals as iv, relabel as rl
from parley.plans import carry, slabs
from parley.sources import adapters as src


def filled(df):
    """Number of partitions that have rows."""
    return df.groupBy(F.spark_partition_id()).count().count()


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_not_sent_through_the_driver(spark, tmp_path):
    """A file of one text over and over is far below the size up to which Spark would broadcast it."""
    spans = spark.range(3000).select(F.lit("m").alias("meeting_id"), F.repeat(F.lit("so "), 500).alias("text"), (F.col("id") * 1000).alias("s"), (F.col("id") * 1000 + 10).alias("e"))
    spans.coalesce(1).write.parquet(str(tmp_path / "spans"))
    a = spark.read.parquet(str(tmp_path / "spans"))
    b = a.select("meeting_id", F.col("text").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = iv.overlap_join(a, b, ["meeting_id"], ("s", "e"), ("s2", "e2"))
    assert "Broadcast" not in plan_of(met) and met.count() == 3000
    summed = slabs.running(a.withColumn("_slab", slabs.slab_of(F.col("s"))), ["meeting_id"], "_slab", ["s"], [slabs.Run("n", "sum", F.lit(1))])
    assert "Broadcast" not in plan_of(summed) and summed.agg(F.max("n")).first()[0] == 3000


def test_edges_are_dealt_out(spark):
    turns = spark.range(400).select(F.lit("m").alias("meeting_id"), F.lit("A").alias("speaker_id"), (F.col("id") * 600_000).alias("start_ms"), (F.col("id") * 600_000 + 50).alias("end_ms"))
    edges = iv.clipped_edges(turns, ["meeting_id"], ["speaker_id"])
    assert filled(edges) >= 8 and edges.count() == 800


def test_pairs_of_texts_are_dealt_out(spark, tmp_path):
    rows = [(i, t, "user", f"text {i} of turn {t}") for i in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    pairs = src.text_pairs(spark, str(tmp_path))
    assert filled(pairs) >= 8 and pairs.count() == 480


def shared_in_pairs(turns, least_ms, least_region_ms):
    """For each turn as a window: shared time, its edges and the speakers, from every pair of a turn and a region."""
    live = [t for t in turns if None not in (t[0], t[2], t[3]) and t[2] < t[3]]
    found = {}
    for m in {t[0] for t in live}:
        mine = [t for t in live if t[0] == m]
        cuts = sorted({t[2] for t in mine} | {t[3] for t in mine})
        for r0, r1 in zip(cuts, cuts[1:]):
            first = {}
            for _, who, s, e, n in mine:
                if s <= r0 and r1 <= e:
                    ord = (s, e, who is not None, who or "", n)
                    first[who] = min(first.get(who, ord), ord)
            in_order = sorted(first, key=first.get)
            for _, _, w0, w1, n in mine if len(first) > 1 else ():
                a, b = max(r0, w0), min(r1, w1)
                if a < b:
                    ms, lows, highs, seen = found.setdefault((m, n), ([], [], [], {}))
                    lows.append(a)
                    highs.append(b)
                    if b - a >= least_region_ms:
                        ms.append(b - a)
                        for pos, who in enumerate(in_order):
                            seen[who] = min(seen.get(who, (r0, pos)), (r0, pos))
    return sorted((*k, sum(ms), min(lows), max(highs), sorted(seen, key=seen.get)) for k, (ms, lows, highs, seen) in found.items() if sum(ms) >= least_ms)


@pytest.mark.parametrize(("longest", "bin_ms"), [(900, 300), (900, 120_000), (20_000, 4_000)])
def test_shared_time_is_that_of_the_pairs(spark, longest, bin_ms):
    """Turns that come twice under one id count twice; null meetings and times are left out."""
    rows = [(["m", "n", None][k % 17 % 3], ["A", "B", "C", None][(k * 7) % 4], (k * 37 * 11) % 6000, (k * 37 * 11) % 6000 + (k * 131) % longest - 5, k // 2) for k in range(90)]
    rows += [*rows[:8], ("m", "A", None, 10, 900), ("m", "A", 5, None, 901)]
    turns = spark.createDataFrame(rows, "meeting_id string, speaker_id string, start_ms int, end_ms int, interval_id long")
    got = iv.significant_overlap(turns, iv.shared_regions(turns, named_from_ms=100), ["meeting_id", "interval_id"], 300, 100, bin_ms)
    want = shared_in_pairs(rows, 300, 100)
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == want


def rows_of_joins(df):
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if kind.endswith("JoinExec"):
            rows += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_windows_are_not_paired_with_every_region_they_touch(spark):
    """Every turn lies over some 400 regions; each speaker in them is met once a bin."""
    turns = spark.range(400).select(
        F.lit("m").alias("meeting_id"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("speaker_id"),
        (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 200_300).alias("end_ms"), F.col("id").alias("interval_id"),
    )
    out = iv.significant_overlap(turns, iv.shared_regions(turns), ["meeting_id", "interval_id"])
    assert out.count() == 400
    assert 400 * 3 <= rows_of_joins(out) <= 400 * 3 * 4


@pytest.mark.parametrize("bin_ms", [700, 600_000])
def test_time_shared_with_names_is_that_of_the_pairs(spark, bin_ms):
    def some(seed):
        rows = [(None if (k * seed) % 31 == 0 else f"m{k % 2}", ["A", "B", None][(k * seed) % 3], (k * seed * 37) % 2500, (k * seed * 37) % 2500 + (k * 13) % 900 - 5, k // 2) for k in range(160)]
        return spark.createDataFrame(rows, "meeting_id string, speaker_id string, start_ms int, end_ms int, interval_id long")

    new, old = some(7), some(11)
    met = iv.overlap_join(
        new.select("meeting_id", F.col("speaker_id").alias("new_id"), F.col("start_ms").alias("n0"), F.col("end_ms").alias("n1")),
        old.select("meeting_id", F.col("speaker_id").alias("old_id"), "interval_id", F.col("start_ms").alias("o0"), F.col("end_ms").alias("o1")),
        ["meeting_id"], ("n0", "n1"), ("o0", "o1"),
    ).groupBy("meeting_id", "new_id", "old_id", "interval_id", "o0").agg(F.sum("overlap_ms").alias("ms"))
    got = rl._time_with_names(new.withColumnRenamed("speaker_id", "new_id"), old, bin_ms).select(met.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, met.collect()), key=str)


def test_groups_go_to_python_together(spark):
    rows = [(f"m{i % 50}" if i % 50 else None, i % 3, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "m string, k long, v long")
    out = T.StructType([T.StructField("v", T.LongType()), T.StructField("note", T.StringType())])

    def run(key, pdf):
        assert pdf["v"].is_monotonic_increasing and all((pdf["m"] == key[0]) | pdf["m"].isna())
        return [(int(pdf["v"].sum()), "")]

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    want = sorted(((m, k, int(g["v"].sum())) for (m, k), g in pd.DataFrame(rows, columns=["m", "k", "v"]).groupby(["m", "k"], dropna=False)), key=str)
    try:
        for records in ("10000", "7"):
            spark.conf.set(size, records)
            done = carry.in_groups(df, ["m", "k"], ["v"], run, out)
            assert "FlatMapGroups" not in done._jdf.queryExecution().toString()
            assert sorted(((None if r.m is None else r.m, r.k, r.v) for r in done.collect()), key=str) == sorted(((None if pd.isna(m) else m, k, v) for m, k, v in want), key=str)
    finally:
        spark.conf.set(size, old)


def test_calls_of_a_model_are_bounded(spark):
    df = spark.range(2000).coalesce(1)
    out = hooks.with_model(df, lambda pdf: pd.Series([str(len(pdf))] * len(pdf)), "answer")
    assert out.agg(F.max(F.col("answer").cast("int"))).first()[0] <= 256 and out.count() == 2000


def test_prompts_are_dealt_out(spark):
    def where_asked(pdf):
        import json

        from pyspark import TaskContext

        at = str(TaskContext.get().partitionId())
        return pd.Series([json.dumps({"items": [{"id": x["id"], "action": "fix", "text": at} for x in json.loads(p)]}) for p in pdf["prompt"]])

    items = spark.createDataFrame([("en", i, i, f"so {i}") for i in range(400)], "lang string, batch long, doc_id long, text string").coalesce(1)
    seen = hooks.ask_batches(items, "lang", "batch", "doc_id", "text", where_asked, backoff=(0.0,))
    assert seen.select("edited").distinct().count() >= 8 and seen.count() == 400
