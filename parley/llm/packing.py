"""Packing of documents into training sequences of at most 4096 tokens.

1. Each document becomes its token ids and an end id. Full windows of a long document are sequences of their own; what
   remains is its tail.
2. The tails' lengths are counted (a histogram of 4095 numbers, whatever the corpus). Shallow combinations of lengths
   that fill a window exactly are enumerated, and non-negative least squares gives the number of repeats of each that
   best explains the histogram. Repeats are rounded down and taken as far as the counts last.
3. Tails are ranked within their length by one range shuffle of short rows. Rank and length say which repeat of which
   combination a tail belongs to, or its place in the stream of residuals, which is cut at every full window. The end
   of the stream is cut at powers of two, which need no padding.

Only tails that a cut divides are tokenized again, for the checksums of their parts.

Defined cases: a null or empty text is its end id alone; rows repeating doc_id and text are packed each; a null doc_id
stays null; no documents give no pieces. Texts are tokenized whole: between ASCII white space, the tokenizer's own
pattern never joins characters, so that runs between it are looked up in a table of known runs first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, table
from .words import byte_runs, heads, mix, pieces, run_hashes, text_bytes

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Known runs a Python worker remembers; a full table is begun anew.
REMEMBERED = 1 << 20
PATTERNS_PER_LENGTH = 8

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), [44, 46])
_VALUES = mix(np.arange(1, 257).astype(np.uint64))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _known(path: str) -> KnownRuns:
    return KnownRuns(path)


class KnownRuns:
    """Ids of runs of text seen before, by hash: sorted hashes, and each run's ids one after the other."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def places(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where distinct hashes stand in the table; unknown runs are tokenized and added."""
        if len(self.hashes) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            data = raw.tobytes()
            runs = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            sizes = np.array([len(x) for x in got], np.int64)
            self.start = np.insert(self.start, at[new], len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, at[new], sizes)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.uint32)])
            at = np.searchsorted(self.hashes, hashes)
        return at


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, each row's followed by the end id, and the rows' offsets."""
    known = _known(path)
    raw, offsets = text_bytes(column)
    inside = ~_SPACE[raw]
    starts, ends = byte_runs(inside, offsets)
    # a letter run ends before a full stop or comma, whatever follows
    cut = np.flatnonzero(_STOP[raw[1:]] & _LETTER[raw[:-1]]) + 1 if len(raw) else np.zeros(0, np.int64)
    cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    hashes = run_hashes(raw, starts, ends, _VALUES)
    head = heads(hashes)
    first = np.flatnonzero(head == np.arange(len(head)))
    first = first[np.argsort(hashes[first])]
    place = np.empty(len(head), np.int64)
    place[first] = known.places(hashes[first], raw, starts[first], ends[first])
    at = place[head]
    # an end id after each row's runs: run sizes with a one for it
    rows = np.searchsorted(starts, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    sizes = known.size[at]
    place = np.arange(len(at)) + row
    all_sizes = np.ones(len(at) + n, np.int64)
    all_sizes[place] = sizes
    all_start = np.full(len(at) + n, len(known.ids), np.int64)
    all_start[place] = known.start[at]
    total = np.cumsum(all_sizes)
    index = np.arange(total[-1] if len(total) else 0) + np.repeat(all_start - (total - all_sizes), all_sizes)
    ids = np.concatenate([known.ids, np.array([END_ID], np.uint32)])[index]
    ends_at = total[rows[1:] + np.arange(n)] if n else total
    return ids, np.concatenate([[0], ends_at]).astype(np.int64)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def measured(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, key, tokens, and checksums of the full windows and of the tail (null: none)."""
    inner = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, offsets = token_ids(piece.column(2), path)
                full, tail = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    whole = (b - a) // window
                    full.append([crc(ids[a + k * window : a + (k + 1) * window]) for k in range(whole)])
                    tail.append(crc(ids[a + whole * window : b]) if (b - a) % window else None)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(offsets)), pa.array(full, pa.list_(pa.int64())), pa.array(tail, pa.int64())],
                    ["doc_id", "key", "tokens", "full", "tail_crc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return inner.mapInArrow(work, f"doc_id {kind}, key long, tokens long, full array<bigint>, tail_crc long")


def combinations(histogram: np.ndarray, window: int = WINDOW, per_length: int = PATTERNS_PER_LENGTH) -> list[dict[int, int]]:
    """Shallow combinations of occurring lengths that fill a window: k of one length and one of another, and two
    lengths that fill a half, twice. For each length, the ones whose second length is the most frequent."""
    out = {}
    for a in np.flatnonzero(histogram).tolist():
        k = np.arange(1, window // a + 1)
        b = window - k * a
        if b[-1] == 0:
            out[((a, int(k[-1])),)] = {a: int(k[-1])}
        k, b = k[(b > 0)], b[b > 0]
        k, b = k[histogram[b] > 0], b[histogram[b] > 0]
        for i in np.argsort(-histogram[b], kind="stable")[:per_length].tolist():
            x = {a: int(k[i])}
            x[int(b[i])] = x.get(int(b[i]), 0) + 1
            out[tuple(sorted(x.items()))] = x
        if 2 * a < window and window % 2 == 0 and histogram[window // 2 - a] and a != window // 2 - a:
            x = {a: 2, window // 2 - a: 2}
            out[tuple(sorted(x.items()))] = x
    return [out[k] for k in sorted(out)]


def repeats(patterns: list[dict[int, int]], histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns, so that their lengths' counts come close to the
    histogram. Accelerated projected gradient on the non-zero entries."""
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([a for p in patterns for a in p], np.int64)
    val = np.array([k for p in patterns for k in p.values()], float)
    size, x = len(histogram), np.zeros(len(patterns))
    # the largest sums of rows and columns bound the square of the matrix's norm
    bound = np.bincount(row, val, size).max() * np.bincount(col, val, len(x)).max()
    y, t = x.copy(), 1.0
    for _ in range(steps):
        miss = np.bincount(row, val * y[col], size) - histogram
        after = np.maximum(0, y - np.bincount(col, val * miss[row], len(x)) / bound)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = after + (last - 1) / t * (after - x), after
    return x


class Plan:
    """Where the tail of a length and a rank within it goes. Made from the histogram alone; size bounded by it."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
        slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        sequence = 0
        patterns = combinations(histogram, window)
        x = np.floor(repeats(patterns, histogram.astype(float))).astype(np.int64) if patterns else np.zeros(0, np.int64)
        # what rounding leaves is taken up by further repeats, the most repeated combinations first
        for wanted in (x, np.full(len(x), np.iinfo(np.int64).max)):
            for i in np.argsort(-x, kind="stable").tolist():
                n = min(int(wanted[i]), *(int(left[a]) // k for a, k in patterns[i].items()))
                if n <= 0:
                    continue
                offset = 0
                for a, k in patterns[i].items():
                    for _ in range(k):
                        slots.append((a, int(used[a]), n, sequence, offset))
                        used[a] += n
                        left[a] -= n
                        offset += a
                sequence += n
        slots.sort()
        self.length, self.rank, self.count, self.sequence, self.offset = (np.array([s[i] for s in slots], np.int64) for i in range(5))
        self.used, self.before = used, np.concatenate([[0], np.cumsum(histogram)[:-1]]).astype(np.int64)
        lengths = np.arange(len(histogram))
        self.stream = np.concatenate([[0], np.cumsum(left * lengths)[:-1]])  # where each length's residuals begin
        total = int((left * lengths).sum())
        self.residual = sequence  # first sequence of the stream
        self.whole = total // window * window
        ends, at, rest = [], self.whole, total % window
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                ends.append(at := at + (1 << bit))
        self.ends = np.array(ends, np.int64)  # of the sequences after the last full one
        self.sequences = sequence + self.whole // window + len(ends)

    def stops(self, at: int) -> tuple[int, int, int]:
        """Sequence, place in it and its end in the stream, for a place in the stream."""
        if at < self.whole:
            return self.residual + at // self.window, at % self.window, (at // self.window + 1) * self.window
        k = int(np.searchsorted(self.ends, at, "right"))
        begin = int(self.ends[k - 1]) if k else self.whole
        return self.residual + self.whole // self.window + k, at - begin, int(self.ends[k])

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """Index of the tail, start in it, length, sequence and offset of each piece."""
        key = (self.length << 40) | self.rank
        slot = np.searchsorted(key, (length << 40) | rank, "right") - 1
        fixed = rank < self.used[length]
        s = slot[fixed]
        who = np.flatnonzero(fixed)
        out = [who.tolist(), [0] * len(who), length[fixed].tolist(), (self.sequence[s] + rank[fixed] - self.rank[s]).tolist(), self.offset[s].tolist()]
        for i in np.flatnonzero(~fixed).tolist():
            n = int(length[i])
            at, done = int(self.stream[n] + (rank[i] - self.used[n]) * n), 0
            while done < n:
                sequence, offset, end = self.stops(at + done)
                take = min(n - done, end - at - done)
                for values, v in zip(out, (i, done, take, sequence, offset), strict=True):
                    values.append(v)
                done += take
        return tuple(out)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = keep(measured(docs, path, window), "sizes")
    tails = sizes.select("doc_id", "key", "tokens", (F.col("tokens") % window).alias("tail"), "tail_crc").filter("tail > 0")
    histogram = np.zeros(window, np.int64)
    for tail, n in tails.groupBy("tail").count().collect():  # at most window - 1 rows
        histogram[tail] = n
    plan = Plan(histogram, window)
    # place in the order by length: partitions hold ranges of it, and the id says partition and row
    order = keep(tails.repartitionByRange("tail", "doc_id", "key").sortWithinPartitions("tail", "doc_id", "key")
                 .withColumn("place", F.monotonically_increasing_id()), "order")
    counts = order.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()  # a row per partition
    parts = np.array([r["part"] for r in counts], np.int64)
    bases = np.concatenate([[0], np.cumsum([r["count"] for r in counts])])[: len(parts)].astype(np.int64)
    known = spark.sparkContext.broadcast((plan, parts, bases))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, parts, bases = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tail, at = batch.column("tail").to_numpy(), batch.column("place").to_numpy()
            rank = bases[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1)) - plan.before[tail]
            who, start, length, sequence, offset = (np.array(x, np.int64) for x in plan.pieces(tail, rank))
            tokens = batch.column("tokens").to_numpy()[who]
            whole = pa.array(length == tail[who])
            crcs = pa.array(np.where(length == tail[who], batch.column("tail_crc").to_numpy()[who], 0), mask=~whole.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(who)), batch.column("key").take(pa.array(who)), pa.array(tokens - tail[who] + start),
                 pa.array(length), crcs, pa.array(tokens), pa.array(sequence), pa.array(offset)],
                ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = keep(order.mapInArrow(place, f"doc_id {kind}, key long, {fields}"), "placed")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, offsets = token_ids(piece.column("text"), path)
                begin = offsets[:-1] + piece.column("start").to_numpy()
                crcs = [crc(ids[a : a + n]) for a, n in zip(begin.tolist(), piece.column("length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *piece.columns[1:3], pa.array(crcs, pa.int64()), *piece.columns[3:6]],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cut = placed.filter("ids_crc32 is null").drop("ids_crc32")
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    wanted = texts.join(cut.select("doc_id", "key").distinct(), (texts.doc_id.eqNullSafe(cut.doc_id)) & (texts.key == cut.key), "left_semi").dropDuplicates(["doc_id", "key"])
    joined = cut.alias("c").join(wanted.alias("t"), F.expr("c.doc_id <=> t.doc_id and c.key = t.key"))
    parts_again = joined.select("c.doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "text").mapInArrow(checked, f"doc_id {kind}, {fields}")
    full = sizes.select("doc_id", "tokens", F.posexplode("full").alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.filter("ids_crc32 is not null").drop("key").unionByName(parts_again).unionByName(full)


def op10_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_least_squares_packing": op10_least_squares_packing}
SQL = {}
