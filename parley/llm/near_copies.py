"""Near-duplicate documents by order MinHash.

A document's k-mers are its runs of five words (a shorter text is one k-mer), each labelled with the number of equal ones
before it, so that a passage that stands twice counts twice. For each of 14 hash functions, the three labelled k-mers of
the smallest hashes are taken and put back into the order of the text; documents share a sketch entry when they have the
same three in the same order, which happens more often the smaller their edit distance is. Texts of at most 100 k-mers,
where three minima agree less often, have six entries more. At a similarity of 0.8, one entry is shared with a
probability of 0.99995 or more.

Two documents are linked if a banded alignment of their k-mers, all of them and in text order, matches at least 0.8 of
them, as aligned / (k-mers of both - aligned): Jaccard's measure for sequences. The band is the largest shift that 0.8
allows, so the alignment loses nothing. Texts that differ in how often they repeat a passage differ by what is repeated.

Copies with the same words are one node from the start (named by a 64-bit hash of the word sequence). The node that
shares most entries leads the others of an entry, and each is aligned with its leaders; then those that share an entry
and are not yet in one class are compared, after exact bounds: length, and the number of differing bits in a bitmap of
the labelled k-mers, which can't exceed the number of differing ones. A bitmap has a bit or two for each k-mer, so that
the bound is as strict for long texts as for short ones; of two sizes, the larger is folded onto the smaller. Groups are
never expanded into all pairs: what a class has already joined is skipped, the rest passes the bounds first.

Defined cases: null and empty texts, and texts without words, are each of a class of their own; equal words are copies
however few; a repeated row gets its class each time; a null doc_id names no class: such a row gets the class of its
copies, and null if none of them has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import compared, in_cells
from .tables import classes, keep, table
from .words import Words, heads, mix, pieces, words_of

KMER = 5
SIMILARITY = 0.8
TABLES = 14
MINIMA = 3
#: Texts of at most so many k-mers have so many more entries.
FEW = 100
MORE = 6
#: Bits of the smallest bitmap.
LEAST_BITS = 256
#: Words of bitmaps that are compared at once.
HELD_WORDS = 1 << 20
_SEEDS = mix(np.arange(1, TABLES + MORE + 1).astype(np.uint64)) | np.uint64(1)


def kmers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all rows, in text order, and the rows' offsets."""
    sizes = np.diff(w.rows)
    counts = np.where(sizes > 0, np.maximum(1, sizes - KMER + 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - w.rows[:-1], counts)
    ends = np.repeat(w.rows[1:], counts)
    out = np.zeros(len(at), np.uint64)
    padded = np.append(w.hashes, np.uint64(0)) if len(w.hashes) else np.zeros(1, np.uint64)
    for i in range(KMER):
        here = np.where(at + i < ends, padded[np.minimum(at + i, len(padded) - 1)], np.uint64(0))
        out = mix(out ^ here)
    return out, offsets


def occurrence(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each k-mer, how many equal ones stand before it in the row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)
    key = mix(hashes ^ mix(row + np.uint64(1)))
    head = heads(key)
    copies = np.flatnonzero(head != np.arange(len(key)))
    number = np.zeros(len(key), np.int64)
    if len(copies):
        order = copies[np.argsort(head[copies], kind="stable")]
        own = head[order]
        at = np.arange(len(order))
        number[order] = at - np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), at, 0)) + 1
    return number


def labelled(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """K-mers with the number of equal ones before them."""
    return np.where(number > 0, mix(hashes + mix(number.astype(np.uint64))), hashes)


def sketches(hashes: np.ndarray, offsets: np.ndarray, number: np.ndarray, seeds: np.ndarray = _SEEDS[:TABLES]) -> np.ndarray:
    """Sketch entries (rows x seeds) of rows that all have a k-mer."""
    own = labelled(hashes, number)
    sizes, n = np.diff(offsets), len(offsets) - 1
    out = np.empty((n, len(seeds)), np.uint64)
    largest = np.uint64(2**64 - 1)
    for t, seed in enumerate(seeds):
        value = own ^ seed
        value *= seed
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        where = np.full((n, MINIMA), -1, np.int64)
        for k in range(MINIMA):
            low = np.minimum.reduceat(value, offsets[:-1])
            at = np.flatnonzero(value == np.repeat(low, sizes))
            row = np.searchsorted(offsets, at, "right") - 1
            real = low[row] < largest
            where[row[real], k] = at[real]
            value[at] = largest
        where.sort(axis=1)
        entry = np.full(n, seed, np.uint64)
        for k in range(MINIMA):
            entry = mix(entry ^ np.where(where[:, k] >= 0, hashes[where[:, k]], np.uint64(0)))
        out[:, t] = entry
    return out


def _rows(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-mers of some rows, and the offsets of these rows among them."""
    sizes = np.diff(offsets)[which]
    own = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(own[-1]) + np.repeat(offsets[which] - own[:-1], sizes), own


def all_entries(hashes: np.ndarray, offsets: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch entries (rows x (tables, more)) of all rows, and which of them a row has."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), TABLES + MORE), np.uint64)
    has = np.zeros(out.shape, bool)
    for which, a, b in ((sizes > 0, 0, TABLES), ((sizes > 0) & (sizes <= FEW), TABLES, TABLES + MORE)):
        which = np.flatnonzero(which)
        if len(which):
            at, rows = _rows(offsets, which)
            out[which, a:b] = sketches(hashes[at], rows, number[at], _SEEDS[a:b])
            has[which, a:b] = True
    return out, has


def bitmaps(own: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each row, the parity of its labelled k-mers in bins: a power of two of them, at least as many as k-mers."""
    sizes = np.diff(offsets)
    bits = np.array([max(LEAST_BITS, 1 << int(n - 1).bit_length()) if n else 0 for n in sizes.tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(base[row] + (own & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [data[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


class Bitmaps:
    """Bitmaps of rows, of different sizes."""

    def __init__(self, bits: np.ndarray):
        self.words = np.frombuffer(b"".join(bits), np.uint64)
        self.sizes = np.array([len(x) // 8 for x in bits], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _folded(self, which: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(which), size), np.uint64)
        for own in np.unique(self.sizes[which]):
            at = np.flatnonzero(self.sizes[which] == own)
            words = self.words[self.starts[which[at], None] + np.arange(own)]
            out[at] = np.bitwise_xor.reduce(words.reshape(len(at), own // size, size), axis=1)
        return out

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of rows x and y, over the smaller size of each two."""
        smaller, out = np.minimum(self.sizes[x], self.sizes[y]), np.zeros(len(x), np.int64)
        for size in np.unique(smaller):
            every = np.flatnonzero(smaller == size)
            step = max(1, HELD_WORDS // int(size))
            for k in range(0, len(every), step):
                at = every[k : k + step]
                out[at] = np.bitwise_count(self._folded(x[at], size) ^ self._folded(y[at], size)).sum(1, dtype=np.int64)
        return out


def fingerprints(w: Words) -> np.ndarray:
    """A 64-bit hash of the word sequence of each row."""
    place = (np.arange(len(w.hashes)) - np.repeat(w.rows[:-1], np.diff(w.rows))).astype(np.uint64)
    total = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(mix(w.hashes ^ mix(place + np.uint64(1))), out=total[1:])
    return mix(total[w.rows[1:]] - total[w.rows[:-1]])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), node (hash of the words; null without words), n (k-mers), entries, bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words_of(piece.column(2))
                hashes, offsets = kmers(w)
                number = occurrence(hashes, offsets)
                entries, has = all_entries(hashes, offsets, number)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)), pa.array(entries[has].view(np.int64)))
                node = pa.array(fingerprints(w).view(np.int64), mask=np.diff(offsets) == 0)
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], node, pa.array(np.diff(offsets)), lists, pa.array(bitmaps(labelled(hashes, number), offsets), pa.binary())],
                                                 ["doc_id", "key", "node", "n", "entries", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(
        work, f"doc_id {kind}, key long, node long, n long, entries array<bigint>, bits binary")


def needed(n: int, m: int, similarity: float = SIMILARITY) -> int:
    """Matches that two texts of n and m k-mers need."""
    return int(np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Longest common subsequence of two k-mer sequences within the band that `least` matches allow; bits of a whole
    row are handled at once. May stop early, below `least`, when that can't be reached."""
    if len(a) > len(b):
        a, b = b, a
    band = len(b) - least
    if band < 0 or len(a) < least:
        return 0
    short = len(a)
    same = a != b[:short]
    head = int(same.argmax()) if same.any() else short
    a, b = a[head:], b[head:]
    same = a[::-1] != b[::-1][: len(a)]
    tail = (int(same.argmax()) if same.any() else len(a)) if len(a) else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = head + tail
    if not len(a) or not len(b):
        return done
    common = np.isin(b, a)
    if done + int(common.sum()) < least:
        return done
    places: dict[int, int] = {}
    wanted = set(b[common].tolist())
    for i, x in enumerate(a.tolist()):
        if x in wanted:
            places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free, strip = full, (1 << (2 * band + 1)) - 1
    for j, (y, hit) in enumerate(zip(b.tolist(), common.tolist(), strict=True)):
        if hit:
            match = places[y] & (strip << (j - band) if j >= band else strip >> (band - j))
            moved = free & match
            free = ((free + moved) | (free - moved)) & full
    return done + len(a) - free.bit_count()


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, seq): the k-mers, in order, of each wanted (node, of), of = (doc_id, key) of a row that has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, offsets = kmers(words_of(piece.column(1)))
                seqs = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(seqs, pa.binary())], ["node", "seq"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    own = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.of.doc_id) & (texts.key == wanted.of.key))
    return own.select("node", "text").mapInArrow(work, "node long, seq binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose alignment is good enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least = needed(len(s), len(t), similarity)
                good.append(aligned(s, t, least) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sequences.select(F.col("node").alias(n), F.col("seq").alias(f"seq_{n}")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(work, "a long, b long")


def _across_classes(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (entry, number, node, class, n, bits) that share an entry, are of two classes and within
    the bounds."""

    def fits(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = c["n"][x] + c["n"][y]
        least = np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)
        out = (c["class"][x] != c["class"][y]) & (least <= np.minimum(c["n"][x], c["n"][y]))
        at = np.flatnonzero(out)
        out[at] = c["maps"].differ(x[at], y[at]) <= total[at] - 2 * least[at]
        return out

    cells = in_cells(members, F.col("entry"), F.col("number"), F.col("node")).drop("number", "entry")
    return compared(cells, ["node"], ["node"], "b long, a long", fits, unpacked=lambda c: {**c, "maps": Bitmaps(c["bits"])})


def _classes_of(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) of each row, and (node, class_id, copies, stays): stays is the first (doc_id, key) of the
    class."""
    rows = keep(sketched(docs), "sketches")
    nodes = keep(rows.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("of"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("entries").alias("entries"), F.first("bits").alias("bits")), "nodes")
    bins = nodes.select("node", "n", F.explode("entries").alias("entry"))
    numbers = bins.groupBy("entry").agg(F.count("*").alias("number")).filter("number > 1")
    shared = keep(bins.join(numbers, "entry"), "shared")
    # the node that shares most entries with others leads those it meets
    weights = shared.groupBy("node").agg(F.sum("number").alias("weight"))
    weighted = shared.select("entry", "node").join(weights, "node")
    leaders = weighted.groupBy("entry").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    pairs = keep(weighted.join(leaders, "entry").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    sequences = keep(_sequences(docs, shared.select("node").distinct().join(nodes.select("node", "of"), "node")), "sequences")
    links = keep(_verified(pairs, sequences, similarity), "links")
    # then those that still meet members of other classes
    known = shared.join(classes(links), "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = known.groupBy("entry").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("entry")
    apart = known.join(mixed, "entry", "left_semi").join(nodes.select("node", "bits"), "node")
    more = _across_classes(apart, similarity).distinct()
    links = keep(links.unionByName(_verified(more, sequences, similarity)), "links")
    final = nodes.select("node", "doc_id", "of", "copies").join(classes(links), "node", "left").withColumn("class", F.coalesce("class", "node"))
    names = final.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min("of").alias("stays"))
    return rows.select("doc_id", "key", "node"), final.join(names, "class").select("node", "class_id", "copies", "stays")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copies): a row for each row of docs. The class is named by its smallest doc_id; copies is the
    number of rows with the same words."""
    rows, named = _classes_of(docs, similarity)
    return rows.join(named, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of each class, the document that names it stays, once. Texts without words all stay."""
    id_ = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows, named = _classes_of(docs, similarity)
    stays = named.select("stays.doc_id", "stays.key").distinct().select(id_("doc_id").alias("_id"), F.col("key").alias("_key"))
    own = docs.select(id_("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    wordless = rows.filter("node is null").select(id_("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    once = own.join(stays, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    both = once.unionByName(own.join(wordless, ["_id", "_key"], "left_semi"))
    return both.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_order_minhash": op1_order_minhash}
SQL = {}
