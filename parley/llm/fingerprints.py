"""Document fingerprints: a digest of quartiles over buckets of hashed byte triplets, and a bounded difference.

Every three consecutive bytes of a text's UTF-8 form are hashed to one of `BUCKETS` buckets and counted. Each bucket is
then encoded by the quartile of all buckets that its count lies in: 0 up to the first quartile of the sorted counts, 1 up
to the median, 2 up to the third, 3 above. The digest is the code of the length (two hexadecimal digits: four steps to a
doubling of the bytes) and a digit for every two buckets, the first one high. Equal texts have equal digests, of any size.

The difference of two digests is the sum of the steps between their codes, and at most `LENGTH_STEPS` for the lengths. It
is bounded by what independent digests differ in, 1.25 steps a bucket, or by all their codes where short texts fill few
buckets. The likeness is 1 minus the bounded difference over that bound.

`edited` holds each text against an edited one, whose last third comes from the next document in descending order of
doc_id. Rows are range-partitioned by doc_id once, so that neighbours stand together; only the last row of a partition
looks for the first row of the next partition that has rows, and only these rows are joined, by the partition's number.

Defined cases: null texts are empty; an empty text has the digest of zeros; rows of equal doc_id follow each other in the
order of their texts' hashes, and null doc_ids come last; a lone row is its own next document; no rows give none; other
columns are ignored. Long texts are digested a piece of `POSITIONS` triplets at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .tables import keep, table
from .words import pieces, text_bytes

BUCKETS = 512
LENGTH_STEPS = 16
#: Steps that two independent digests differ in on average, when all buckets are in use.
INDEPENDENT = BUCKETS * 5 // 4
POSITIONS = 1 << 20
PART_BYTES = 64 << 20
_FACTOR, _BITS = 2654435761, 32 - (BUCKETS - 1).bit_length()


def bucket_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many byte triplets of each row fall into each bucket."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, np.int64)
    inside = np.ones(max(0, len(raw) - 2), bool)  # triplets that cross no row's end
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    row = np.repeat(np.arange(n), np.diff(offsets))
    for k in range(0, len(inside), POSITIONS):
        end = min(k + POSITIONS, len(inside))
        b = raw[k : end + 2].astype(np.uint64)
        triplet = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
        bucket = ((triplet * np.uint64(_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(_BITS)
        place = (row[k:end] * BUCKETS + bucket.astype(np.int64))[inside[k:end]]
        if len(place):
            first = int(place.min()) // BUCKETS * BUCKETS  # a piece touches few rows
            got = np.bincount(place - first)
            counts[first : first + len(got)] += got
    return counts.reshape(n, BUCKETS)


def length_codes(sizes: np.ndarray) -> np.ndarray:
    """Four steps to a doubling of size + 1."""
    n = sizes.astype(np.int64) + 1
    power = np.array([int(x).bit_length() - 1 for x in n], np.int64)
    return 4 * power + (((n << 2) >> power) & 3)


class Digests:
    """Quartile codes and length codes of a column of texts."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        counts = bucket_counts(raw, offsets)
        quarter = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
        self.codes = sum((counts > quarter[:, [k * BUCKETS // 4 - 1]]).astype(np.int8) for k in (1, 2, 3))
        self.sizes = length_codes(np.diff(offsets))

    def texts(self) -> list[str]:
        pairs = (self.codes[:, ::2] * 4 + self.codes[:, 1::2]).astype(np.uint8)
        both = (pairs[:, ::2] << 4 | pairs[:, 1::2]).tobytes().hex()
        wide = BUCKETS // 2
        return [f"{s:02x}{both[i * wide:(i + 1) * wide]}" for i, s in enumerate(self.sizes)]

    @classmethod
    def read(cls, digests: list[str]) -> Digests:
        out = cls.__new__(cls)
        pairs = np.array([[int(c, 16) for c in d[2:]] for d in digests], np.int8).reshape(len(digests), BUCKETS // 2)
        out.codes = np.stack([pairs >> 2, pairs & 3], axis=2).reshape(len(digests), BUCKETS)
        out.sizes = np.array([int(d[:2], 16) for d in digests], np.int64)
        return out


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """1 - bounded difference, row by row."""
    steps = np.abs(a.codes - b.codes).sum(1, dtype=np.int64) + np.minimum(np.abs(a.sizes - b.sizes), LENGTH_STEPS)
    bound = np.minimum(INDEPENDENT, a.codes.sum(1, dtype=np.int64) + b.codes.sum(1, dtype=np.int64)) + LENGTH_STEPS
    return 1 - np.minimum(steps, bound) / bound


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(Digests(piece.column(1)).texts())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fingerprint string")


@F.pandas_udf(DoubleType())
def digest_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints; null where one is."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = likeness(Digests.read(a[known].tolist()), Digests.read(b[known].tolist()))
    return pd.Series(out)


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The result's columns for texts and their next ones."""
    sizes = [len(t) for t in texts]
    changed = [t[: n - n // 3] + f[: n // 3] for t, f, n in zip(texts, following, sizes, strict=True)]
    own, other, after = (Digests(pa.array(x, pa.string())) for x in (texts, changed, following))
    return [pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(own.texts()), pa.array(other.texts()),
            pa.array(likeness(own, other)), pa.array(likeness(own, after))]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a partition but its last, which goes on as it is, with the first row's text."""
    names = ["doc_id", *_RESULT, "first", "last"]
    held = first = part = None  # held: the row that waits for the next one

    def open_row(doc_id, start, text):
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([doc_id], pa.int64()), *blank, pa.array([start]), pa.array([text])], ["part", *names])

    for batch in batches:
        for piece in pieces(batch, "text"):
            ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            if held is None:
                first, part = texts[0], piece.column(2)[0].as_py()
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids.pop(), texts[-1])
            if ids:
                n = len(ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array(ids, pa.int64()), *_edited(texts[:-1], texts[1:]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["part", *names])
    if held is not None:
        yield open_row(held[0], first, held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows whose next text has been joined to them."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, text, following = batch.slice(i, 1).columns
            yield pa.RecordBatch.from_arrays([doc_id, *_edited(text.to_pylist(), following.to_pylist())], ["doc_id", *_RESULT])


def edited(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = 1 + max(size // part_bytes, min(size // (1 << 20), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    # rows alike in doc_id and text may be dealt to several partitions: which is which makes no difference
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("spread")]
    dealt = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    made = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_neighbours, f"part int, doc_id long, {_SCHEMA}, first string, last string")
    made = keep(made, "fingerprints")
    ends = made.filter(F.col("last").isNotNull())
    # numbers of partitions only: one row for each
    every = Window.orderBy("part")
    least = F.first("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbers = ends.select("part").select("part", F.coalesce(F.lead("part").over(every), least).alias("after"))
    starts = ends.select(F.col("part").alias("after"), F.col("first").alias("following"))
    met = ends.select("part", "doc_id", "last").join(numbers, "part").join(starts, "after").select("doc_id", "last", "following")
    return made.filter(F.col("last").isNull()).select("doc_id", *_RESULT).unionByName(met.mapInArrow(_across, f"doc_id long, {_SCHEMA}"))


def op12_quartile_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))


_SQL = f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, n - n // 3) || substr(f, 1, n // 3) AS x FROM n),
every AS (SELECT DISTINCT unnest([t, x]) AS t FROM e),
bytes AS (SELECT t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM every),
trip AS (SELECT t, unnest(list_transform(range(1, len(b) - 1), lambda i: (((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * {_FACTOR}) % 4294967296) // {1 << _BITS})) AS bucket FROM bytes),
counted AS (SELECT t, bucket, count(*) AS c FROM trip GROUP BY t, bucket),
filled AS (SELECT k.t, k.bucket, coalesce(c, 0) AS c FROM (SELECT t, unnest(range({BUCKETS})) AS bucket FROM every) k LEFT JOIN counted USING (t, bucket)),
quarters AS (SELECT t, list_sort(list(c)) AS s FROM filled GROUP BY t),
coded AS (SELECT t, bucket, CAST(c > s[{BUCKETS // 4}] AS INT) + CAST(c > s[{BUCKETS // 2}] AS INT) + CAST(c > s[{3 * BUCKETS // 4}] AS INT) AS code FROM filled JOIN quarters USING (t)),
sized AS (SELECT t, strlen(t) + 1 AS n, length(bin(strlen(t) + 1)) - 1 AS k FROM every),
digests AS (SELECT t, list(code ORDER BY bucket) AS codes, any_value(4 * k + ((n * 4) // (CAST(1 AS BIGINT) << k)) % 4) AS size FROM coded JOIN sized USING (t) GROUP BY t),
named AS (SELECT t, codes, size, printf('%02x', size) || array_to_string(list_transform(range(1, {BUCKETS}, 2), lambda i: substr('0123456789abcdef', codes[i] * 4 + codes[i + 1] + 1, 1)), '') AS name FROM digests),
pairs AS (SELECT t AS a, x AS b FROM e UNION SELECT t AS a, f AS b FROM e),
differ AS (SELECT a, b, list_sum(list_transform(list_zip(p.codes, q.codes), lambda z: abs(z[1] - z[2]))) + least(abs(p.size - q.size), {LENGTH_STEPS}) AS steps,
                  least({INDEPENDENT}, list_sum(p.codes) + list_sum(q.codes)) + {LENGTH_STEPS} AS bound
           FROM pairs JOIN named p ON p.t = a JOIN named q ON q.t = b),
alike AS (SELECT a, b, 1 - CAST(least(steps, bound) AS DOUBLE) / CAST(bound AS DOUBLE) AS near FROM differ)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, p.name AS fingerprint, q.name AS edited_fingerprint, u.near AS near_edited, v.near AS near_next
FROM e JOIN named p ON p.t = e.t JOIN named q ON q.t = e.x JOIN alike u ON u.a = e.t AND u.b = e.x JOIN alike v ON v.a = e.t AND v.b = e.f"""


QUERIES = {"op12_quartile_fingerprint": op12_quartile_fingerprint}
SQL = {"op12_quartile_fingerprint": _SQL}
