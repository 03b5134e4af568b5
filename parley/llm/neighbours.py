"""Nearest neighbours by multi-index hashing.

Codes: vectors, lengthened by one component so that the inner product orders like the angle whatever their norms, are
turned by two learned rotations (iterative quantisation on a bounded sample) and their 128 signs are the code. A code
falls into 16 substrings of 8 bits, and each is an index of its own: rows in order of the substring's value.

Search: if two codes differ in at most r bits, they differ in some substring by at most floor(r / 16), by the pigeonhole
principle, and in the first r mod 16 + 1 substrings or by one bit less elsewhere. So probing the values this close to
the query's substrings finds every code within r. The rows found within r are reranked by their inner products with
the query in double precision. The radius of a query is learned from the sample: the one that holds `SHARE` of it, and
at least `LEAST` rows of the table; as a share, not a number, it keeps the recall at every size.

Every row is indexed. Blocks of the index meet blocks of the queries, and the best of each are merged; both blocks are
bounded. Recall is measured against brute force in the tests.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no
part; rows with a null vec_id neither; a row is no neighbour of rows with its own vec_id; ties go to the smaller
vec_id; a table with fewer candidates gives them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, table

K = 20
BITS, PARTS = 128, 16
WIDTH = BITS // PARTS
SAMPLE = 4096
SHARE, LEAST = 0.08, 400
INDEX_ROWS, QUERY_ROWS = 1 << 14, 1 << 10


def rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """Directions (dimensions x bits): orthogonal matrices, each turned so that the sample lies close to its signs."""
    rng = np.random.default_rng(seed)
    d, out = sample.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(sample.T @ np.sign(sample @ turn))
            turn = left @ right
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :bits]


def codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows x 16) bytes: the substrings of each code."""
    return np.packbits(vectors @ turn > 0, axis=1)


def lengthened(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more component, so that all have the length of the longest."""
    short = np.maximum(0, 1 - (vectors * vectors).sum(1) / (largest * largest))
    return np.concatenate([vectors / largest, np.sqrt(short)[:, None]], axis=1)


def neighbours_of(byte: int, most: int) -> np.ndarray:
    """Values that differ from a byte in at most `most` bits."""
    masks = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(WIDTH), k)]
    return np.array(masks, np.int64) ^ byte


class Index:
    """The substring tables of a block of codes."""

    def __init__(self, block: np.ndarray):
        self.codes = block.view(np.uint64)
        self.order = [np.argsort(block[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.searchsorted(block[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from this one in at most `radius` bits."""
        if radius >= BITS // 2:
            near = np.arange(len(self.codes))
        else:
            met = np.zeros(len(self.codes), bool)
            for j in range(PARTS):
                most = radius // PARTS - (j > radius % PARTS)
                if most < 0:
                    continue
                for value in neighbours_of(int(code[j]), most).tolist():
                    a, b = self.starts[j][value], self.starts[j][value + 1]
                    met[self.order[j][a:b]] = True
            near = np.flatnonzero(met)
        differ = np.bitwise_count(self.codes[near] ^ code.view(np.uint64)).sum(1)
        return near[differ <= radius]


def radii(query: np.ndarray, sample: np.ndarray, rows: int) -> np.ndarray:
    """For each query, the radius that holds the wanted share of the sample's codes."""
    share = min(1.0, max(SHARE, LEAST / max(1, rows)))
    at = min(len(sample) - 1, int(np.ceil(share * len(sample))))
    if share >= 1:
        return np.full(len(query), BITS)
    differ = np.bitwise_count(query.view(np.uint64)[:, None, :] ^ sample.view(np.uint64)[None]).sum(2)
    return np.partition(differ, at, axis=1)[:, at]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, components as doubles."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select("vec_id", v.alias("v")).filter(ok)


def nearest(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for the rows whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    schema = f"query_id long, rank int, vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("largest")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n, largest = sizes.d, sizes.n, float(np.sqrt(sizes.largest))
    rows = rows.filter(F.size("v") == d)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = lengthened(np.stack(picked.to_list()), largest)
    turn = rotations(sample)
    known = spark.sparkContext.broadcast((turn, largest, codes(sample, turn)))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, largest, _ = known.value
        for batch in batches:
            if len(batch):
                v = lengthened(np.stack(batch["v"].to_list()), largest)
                yield batch.assign(code=[c.tobytes() for c in codes(v, turn)])

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, _, sample = known.value
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_list())
                v = np.concatenate([v / np.sqrt((v * v).sum(1))[:, None], np.zeros((len(v), 1))], axis=1)
                own = codes(v, turn)
                yield batch.assign(code=[c.tobytes() for c in own], radius=radii(own, sample, n))

    id_ = embeddings.schema["vec_id"].dataType.simpleString()
    index = keep(rows.mapInPandas(coded, f"vec_id {id_}, v array<double>, code binary"), "codes")
    queries = keep(rows.filter(F.col("vec_id") % every == 0).mapInPandas(asked, f"vec_id {id_}, v array<double>, code binary, radius long"), "queries")
    blocks, query_blocks = -(-n // INDEX_ROWS), max(1, -(-n // (every * QUERY_ROWS)))

    def best(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            block = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), PARTS)
            index, vectors, ids = Index(block), np.stack(mine["v"].to_list()), mine["vec_id"].to_numpy()
            for who, v, code, radius in zip(theirs["vec_id"], theirs["v"], theirs["code"], theirs["radius"], strict=True):
                near = index.within(np.frombuffer(code, np.uint8), radius)
                near = near[ids[near] != who]
                score = (vectors[near] * v).sum(1)
                if len(near) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[score >= least], score[score >= least]
                order = np.lexsort([ids[near], -score])[:k]
                out.append(pd.DataFrame({"query_id": who, "vec_id": ids[near][order], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    left = dealt(index, "block", blocks, "queries", query_blocks).groupBy("block", "queries")
    right = dealt(queries, "queries", query_blocks, "block", blocks).groupBy("block", "queries")
    found = left.cogroup(right).applyInPandas(best, f"query_id long, vec_id {id_}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_multi_index_hashing": op5_multi_index_hashing}
SQL = {}
