"""Rows whose work is long though they are few bytes are dealt out to all cores."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from parley.operators import reconcile as rc
from parley.sources import adapters as src


def filled(df):
    """Number of partitions that have rows."""
    return df.groupBy(F.spark_partition_id()).count().count()


def test_one_row_group_is_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(400), "text": [f"text {i} " * 50 for i in range(400)]}), tmp_path / "d.parquet", row_group_size=400, compression="none")
    size = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "8k")
    try:
        one = spark.read.parquet(str(tmp_path / "d.parquet"))
        assert one.rdd.getNumPartitions() >= 8 and filled(one) == 1
        out = src.spread(one)
        assert filled(out) >= 8
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, one.collect()))
    finally:
        spark.conf.set(size, old)


def test_cleaned_texts_are_dealt_out_and_written(spark):
    rows = [(i, f"so it goes so it goes {i}") for i in range(200)] + [(200, "..."), (201, None)]
    out = rc.clean_texts(spark.createDataFrame(rows, "i long, text string").coalesce(1))
    assert len(out.inputFiles()) >= 8  # one of each task that cleaned
    assert sorted((r.i, r.text) for r in out.collect()) == [(i, f"so it goes {i}") for i in range(200)]


def test_a_fold_is_dealt_out(spark):
    spans = [(f"m{i}", 0, 1000, "A", f"word {i} and more", False, False, []) for i in range(100)]
    s = spark.createDataFrame(spans, "meeting_id string, start_ms long, end_ms long, speaker_id string, text string, is_overlap boolean, provisional boolean, overlap_speakers array<string>")
    out = rc.merge_adjacent(s, ["meeting_id"])
    assert len(out.inputFiles()) >= 8 and out.count() == 100
