"""Live meetings as Structured Streaming over the same tables as the batch jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.operators import reconcile as rc
from parley.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Process all there is, write every batch with its number, and read the result back.

    Batches are written under their own number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{folder}/out").drop("part")


def latest_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of everything published, the rows of each key's newest batch."""
    newest = df.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return df.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def live_windows(
    samples: DataFrame, window_ms: int, hop_ms: int, min_rms: float, delay: str = "0 seconds"
) -> DataFrame:
    """Every loud hopping window of a meeting, once, when the watermark has passed its end.

    `samples` has meeting_id, at (timestamp), at_ms (from the meeting's start) and x.
    Windows count from the start of the meeting, not from the epoch.
    """
    t = F.col("at_ms")
    first = F.greatest(F.lit(0), F.floor((t - window_ms) / hop_ms) + 1)
    w = samples.withColumn("window_no", F.explode(F.sequence(first, F.floor(t / hop_ms))))
    w = w.where(t < F.col("window_no") * hop_ms + window_ms)
    left_ms = F.col("window_no") * hop_ms + window_ms - t
    w = w.withColumn("window_end", F.timestamp_millis(F.unix_millis("at") + left_ms))
    return (
        w.withWatermark("window_end", delay)
        .groupBy("meeting_id", "window_no", "window_end")
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n_samples"))
        .where(F.col("rms") >= min_rms)
        .select(
            "meeting_id", "window_no", (F.col("window_no") * hop_ms).alias("start_ms"),
            (F.col("window_no") * hop_ms + window_ms).alias("end_ms"), "rms", "n_samples",
        )
    )


def republish(intervals: DataFrame, keys: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """For `run_available`: each changed key's provisional segments, replaced as a whole."""

    def publish(buffer: DataFrame, number: int) -> DataFrame:
        w = buffer.withColumnRenamed("row_no", "window_id").withColumn("words", F.array().cast(rc.WORDS))
        return rc.align_windows(w, intervals, keys, provisional=True)

    return publish


def activity_sessions(frames: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """Spans in which a stream sends without a pause of `gap`; works on tables and streams."""
    s = frames.groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_frames"))
    return s.select(*keys, F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "n_frames")


def relabel_changed(frames: DataFrame, turns: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """For `run_available` or a timed trigger: turns anew over the whole recording of meetings with new frames."""

    def relabel(batch: DataFrame, number: int) -> DataFrame:
        changed = batch.select("meeting_id").distinct()
        return turns(frames.join(changed, "meeting_id", "left_semi"))

    return relabel


def update_events(rows: DataFrame, event_type: Column, columns: list[str]) -> DataFrame:
    """Typed events for the clients of a meeting, one per changed row."""
    return rows.select("meeting_id", event_type.alias("event_type"), F.to_json(F.struct(*columns)).alias("payload"))
