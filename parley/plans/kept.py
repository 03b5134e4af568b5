"""Results written to the shared folder and read back: computed once, and safe when executors are lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.session import ensure_checkpoint_dir


def _path(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """The same rows from a Parquet table below `spark.checkpoint.dir`; files go with that folder.

    Unlike checkpoint(), which runs the plan once to count and once to write, this runs it once.
    """
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, by: list[str], name: str = "kept") -> DataFrame:
    """As keep, in as many buckets of `by` as a shuffle has partitions: joins and groupings by these columns (and more)
    read the buckets as they lie, without another shuffle.  The table is known to this session under a name of its own."""
    spark = df.sparkSession
    path = _path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", path).saveAsTable(known)
    return spark.table(known)
