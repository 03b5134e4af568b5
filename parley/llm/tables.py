"""Tables the operators share: inputs, results kept in the shared folder, summed count blocks, connected classes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, tasks get texts in smaller Arrow batches: whole documents are long, and several copies of a
    batch are in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, name: str = "kept", release: Iterable[Broadcast] = ()) -> DataFrame:
    """Write a result to the shared folder and read it back: it is computed once, and lost executors don't matter.
    What was sent out for it is then released.

    The files go with the folder of the session; `spark.checkpoint.dir` should be on storage that expires.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    for sent in release:
        sent.destroy()
    return spark.read.schema(df.schema).parquet(path)


def renamed(docs: DataFrame, *others: str | Column) -> DataFrame:
    """All columns under names of no meaning (`_c0`, ...), so that none clashes, and some of them again as they are."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], *others)


def named(df: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of docs back under their names; `text` is the column to take for text."""
    return df.select(*[F.col(text if text and c == "text" else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def remainder(doc_id: str, by: int):
    """crc32 of the document's id as text, by `by`; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def packed(counts: np.ndarray) -> bytes:
    """An array of 64-bit numbers, mostly zeros, as compressed bytes."""
    return zlib.compress(np.ascontiguousarray(counts).tobytes(), 1)


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def sum_blocks(df: DataFrame, add_up=np.add) -> DataFrame:
    """Sum (or another ufunc) of the packed arrays in `counts` for each `block`, added up as they stream in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = unpacked(counts.as_buffer())
                total[block] = add_up(total[block], got) if block in total else got
        for block, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed(counts)], pa.binary())], ["block", "counts"])

    return df.select("block", "counts").repartition("block").mapInArrow(add, "block string, counts binary")


class Filter:
    """A Bloom filter of 64-bit hashes: members always pass, others rarely while it is not full. Its size is bounded."""

    LARGEST = 28  #: as a power of two of bits; more members than it holds let more pass, never less

    def __init__(self, rows: DataFrame, members: int, hash_of=lambda x: x.view(np.uint64)):
        """`hash_of` makes the hashes of the rows' columns."""
        self.bits = min(self.LARGEST, max(20, int(16 * members).bit_length()))
        bits, block = self.bits, 1 << 14

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(1 << (bits - 6), np.uint64)
            for batch in batches:
                for at in _places(hash_of(*(c.to_numpy() for c in batch.columns)), bits):
                    np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            for k in range(0, len(words), block):
                part = words[k : k + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([str(k)]), pa.array([packed(part)], pa.binary())], ["block", "counts"])

        self.words = np.zeros(1 << (bits - 6), np.uint64)
        for r in sum_blocks(rows.mapInArrow(work, "block string, counts binary"), np.bitwise_or).collect():
            got = unpacked(r.counts).view(np.uint64)
            self.words[int(r.block) : int(r.block) + len(got)] = got

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        yield (hashes * np.uint64(k)) >> np.uint64(64 - bits)


def classes(links: DataFrame) -> DataFrame:
    """(node, class) of the connected nodes of links (a, b): the class is the smallest node. Nodes are longs.

    Each round hands the smallest known label to the neighbours and then to all that share the old label, so that
    chains shorten quickly; rounds are kept in the shared folder.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        met = labels.join(near, "node").withColumn("near", F.least("class", "near"))
        hop = met.groupBy("class").agg(F.min("near").alias("hop"))
        after = keep(met.join(hop, "class").select("node", F.least("near", "hop").alias("new"), "class"), "labels")
        if after.filter(F.col("new") != F.col("class")).isEmpty():
            return after.select("node", "class")
        labels = after.select("node", F.col("new").alias("class"))
