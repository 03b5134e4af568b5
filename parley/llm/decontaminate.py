"""Benchmark decontamination: an FM-index per training shard finds every benchmark window.

A shard is the part of the training text that a task holds at a time. Words that occur in no benchmark item cannot be
part of an occurrence, so they end a stretch; stretches shorter than the shortest window are left out of the index
(no window fits). Backward search through wavelet-matrix ranks finds the suffix range of all windows together, sampled
suffix positions tell where they are, and the spans found are merged per document.

The benchmark may be of any size: items are cut into chunks in Spark, dealt out to passes by their hashes, and the
windows of one pass at a time are fetched and sent to the tasks. What a pass found goes on with the documents.

Defined cases: null texts have no words; items without words or without an id are left out; rows with equal item_id are
one item; repeated documents are judged each; an empty benchmark hits nothing. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import keep, named, renamed, table
from .words import Words, pieces, words_of

WINDOW = 13
#: Benchmark text held by each task at a time; a larger benchmark is searched in several passes.
PASS_CHARS = 32 << 20
#: Windows of an item that one row holds.
CHUNK_WORDS = 4096
SHARD_SYMBOLS = 1 << 20
SAMPLE_EVERY = 8


@dataclass
class Phrases:
    """All distinct windows of some benchmark items, as symbols 1.. of the benchmark's own vocabulary."""

    vocabulary: np.ndarray  #: sorted word hashes; symbol = place + 1
    present: np.ndarray  #: whether any vocabulary word has these 16 leading bits
    symbols: np.ndarray  #: windows, right-aligned in rows, 0 for no word
    lengths: np.ndarray
    items: list[np.ndarray]  #: for each window, places in names
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases_of(names: list[str], texts: list[str], window: int = WINDOW) -> Phrases:
    w = words_of(pa.array(texts, pa.large_string()))
    vocabulary = np.unique(w.hashes)
    symbols = np.searchsorted(vocabulary, w.hashes).astype(np.int64) + 1
    found: dict[bytes, set[int]] = {}
    order = {n: i for i, n in enumerate(dict.fromkeys(names))}
    for k, name in enumerate(names):
        own = symbols[w.rows[k] : w.rows[k + 1]]
        if not len(own):
            continue
        rows = np.lib.stride_tricks.sliding_window_view(own, window) if len(own) >= window else own[None]
        padded = np.zeros((len(rows), window), np.int64)
        padded[:, window - rows.shape[1] :] = rows
        for row in padded:
            found.setdefault(row.tobytes(), set()).add(order[name])
    table_ = np.array([np.frombuffer(k, np.int64) for k in found], np.int64).reshape(-1, window)
    present = np.zeros(1 << 16, bool)
    present[vocabulary >> np.uint64(48)] = True
    return Phrases(vocabulary, present, table_, (table_ > 0).sum(1), [np.array(sorted(v)) for v in found.values()], list(order))


def symbols_in(hashes: np.ndarray, phrases: Phrases) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(phrases.present[hashes >> np.uint64(48)])
    at = np.searchsorted(phrases.vocabulary, hashes[maybe])
    hit = phrases.vocabulary[np.minimum(at, len(phrases.vocabulary) - 1)] == hashes[maybe]
    out[maybe[hit]] = at[hit] + 1
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. Symbols at most 0 are distinct end marks, in text order."""
    n, marks = len(text), text <= 0
    rank = np.where(marks, np.cumsum(marks) - 1, text + marks.sum())
    rank, reach = np.unique(rank, return_inverse=True)[1].astype(np.int64), 1
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-reach] = rank[reach:] + 1
        rank, reach = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64), 2 * reach
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Backward search over one shard. The text is symbols from 1, each stretch ended by a 0."""

    def __init__(self, text: np.ndarray, every: int = SAMPLE_EVERY):
        self.n = n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        #: symbols before each symbol; rows of smaller symbols come first
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.levels: list[np.ndarray] = []  # ones before each place, for each bit from the highest
        current = last
        for bit in reversed(range(self.bits)):
            one = (current >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            current = np.concatenate([current[one == 0], current[one == 1]])
        self.last = last
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0
        self.sampled = (order % every == 0) | starts[order]
        self.place = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `end` last symbols."""
        low, high = np.zeros(len(end), np.int64), end.astype(np.int64)
        for level, bit in zip(self.levels, reversed(range(self.bits)), strict=True):
            zeros = self.n - int(level[-1])
            a, b = level[low], level[high]
            up = ((symbol >> bit) & 1).astype(bool)
            low = np.where(up, zeros + a, low - a)
            high = np.where(up, zeros + b, high - b)
        return high - low

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern: rows of symbols, right-aligned, 0 for no symbol."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        top = len(self.before) - 2
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[:, column]
            go = np.flatnonzero((symbol > 0) & (high > low))
            high[(symbol > top)] = 0
            go = go[symbol[go] <= top]
            if len(go):
                s = symbol[go]
                low[go], high[go] = self.before[s] + self.rank(s, low[go]), self.before[s] + self.rank(s, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of the suffix in each row: step back to a sampled row and count the steps."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, who = rows.copy(), np.arange(len(rows))
        while len(who):
            done = self.sampled[at]
            out[who[done]] = self.position[self.place[at[done]]] + steps
            at, who = at[~done], who[~done]
            s = self.last[at]
            at, steps = self.before[s] + self.rank(s, at), steps + 1
        return out


def occurrences(index: FMIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Start in the shard's text and number of the window, for each occurrence."""
    low, high = index.find(phrases.symbols)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return index.locate(rows), window


def stretches(symbols: np.ndarray, rows: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches of benchmark words that a window can fit in, each ended by 0, and the word of each."""
    n = len(symbols)
    inside, first = symbols > 0, np.zeros(n + 1, bool)
    first[rows] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1 if n else starts
    long_enough = ends - starts >= max(1, shortest)
    starts, sizes = starts[long_enough], (ends - starts)[long_enough] + 1
    word = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    out = symbols[np.minimum(word, max(0, n - 1))] if n else np.zeros(0, np.int64)
    out[np.cumsum(sizes) - 1] = 0
    return out, word


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _cut(w: Words, row: int, spans: list[tuple[int, int]]) -> str:
    """The row's text without the words of the spans and what stands between them."""
    at, end, parts = w.offsets[row], w.offsets[row + 1], []
    for a, b in spans:
        parts.append(w.raw[at : w.starts[w.rows[row] + a]].tobytes())
        at = w.ends[w.rows[row] + b - 1]
    return b"".join([*parts, w.raw[at:end].tobytes()]).decode("utf-8", "replace")


def _hits(ws: list[Words], phrases: Phrases, shard: int) -> list[list[tuple[list[tuple[int, int]], set[int]]]]:
    """For each piece and row: merged spans of words, and the items found."""
    out = [[([], set()) for _ in range(len(w.rows) - 1)] for w in ws]
    if not len(phrases.lengths):
        return out
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def search() -> None:
        text = np.concatenate([x[1] for x in waiting])
        at, window = occurrences(FMIndex(text), phrases)
        piece = np.repeat([x[0] for x in waiting], [len(x[1]) for x in waiting])[at]
        word = np.concatenate([x[2] for x in waiting])[at]
        for k in np.unique(piece):
            own = piece == k
            start, rows = word[own], ws[k].rows
            row = np.searchsorted(rows, start, "right") - 1
            for r, i in {*zip(row.tolist(), window[own].tolist(), strict=True)}:
                out[k][r][1].update(phrases.items[i].tolist())
            for a, b in zip(*merged(start, start + phrases.lengths[window[own]]), strict=True):
                r = int(np.searchsorted(rows, a, "right")) - 1  # touching spans of neighbouring rows
                while a < b:
                    out[k][r][0].append((int(a - rows[r]), int(min(b, rows[r + 1]) - rows[r])))
                    a, r = min(b, rows[r + 1]), r + 1
                    while a < b and rows[r + 1] <= a:
                        r += 1
        waiting.clear()

    held = 0
    for k, w in enumerate(ws):
        text, word = stretches(symbols_in(w.hashes, phrases), w.rows, phrases.shortest)
        if len(text):
            waiting.append((k, text, word))
            held += len(text)
        if held > shard:
            search()
            held = 0
    if waiting:
        search()
    return out


_FOUND = "_items array<string>, _spans array<struct<start:bigint,end:bigint>>"


def _searched(docs: DataFrame, phrases: Phrases, first: bool, last: bool, clean: bool) -> tuple[DataFrame, Broadcast]:
    """One pass: docs has columns, (from the second pass on) `_items` and `_spans`, and `_text` at the end. The last
    pass gives `_words`, `_hit`, `_items`, `_spans` and `_clean`, those before it docs as the next one takes it."""
    known = docs.sparkSession.sparkContext.broadcast(phrases)
    columns = docs.schema.fields[: -1 if first else -3]
    tail = f"_words long, _hit long, {_FOUND}" + ", _clean string" * clean if last else f"{_FOUND}, _text string"
    out = T.StructType(columns + T.StructType.fromDDL(tail).fields)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = known.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a shard's worth of pieces
                ws, rows, size = [], 0, 0
                for piece in pieces(batch.slice(at), "_text"):
                    ws.append(words_of(piece.column(piece.num_columns - 1)))
                    rows, size = rows + piece.num_rows, size + len(ws[-1].raw)
                    if size > 16 << 20:
                        break
                shard = batch.slice(at, rows)
                at += rows
                spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
                items: list[set[str]] = [set() for _ in range(rows)]
                if not first:
                    items = [set(x) for x in shard.column(len(columns)).to_pylist()]
                    spans = [[(y["start"], y["end"]) for y in x] for x in shard.column(len(columns) + 1).to_pylist()]
                for r, (s, i) in enumerate(x for found in _hits(ws, phrases, SHARD_SYMBOLS) for x in found):
                    if s:
                        spans[r] = list(zip(*(x.tolist() for x in merged(*np.array(spans[r] + s).T)), strict=True)) if spans[r] else s
                    items[r].update(phrases.names[k] for k in i)
                found = [pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span_type)]
                whole = shard.column(shard.num_columns - 1)
                if not last:
                    arrays = [*found, whole]
                else:
                    arrays = [pa.array(np.concatenate([np.diff(w.rows) for w in ws]), pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), *found]
                    if clean:
                        where = [(w, r) for w in ws for r in range(len(w.rows) - 1)]
                        arrays.append(pa.array([_cut(*where[r], s) if s else whole[r].as_py() for r, s in enumerate(spans)], pa.string()))
                yield pa.RecordBatch.from_arrays([*shard.columns[: len(columns)], *arrays], out.fieldNames())

    return docs.mapInArrow(work, out), known


def find_passages(docs: DataFrame, passes: list[Callable[[], Phrases]], columns: list[str], text: str = "text", clean: bool = False) -> DataFrame:
    """`columns` of each document with `_words`, `_hit` (words), `_items` (ids), `_spans` (of words, merged) and, if
    asked for, `_clean`: the text without the spans. Passes come one after the other: what one found goes on with the
    documents to the next, and its windows are released."""
    inner = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("_text"))
    for k, phrases in enumerate(passes):
        last = k == len(passes) - 1
        inner, sent = _searched(inner, phrases(), k == 0, last, clean)
        if not last:
            inner = keep(inner, "searched", [sent])
    return inner


def item_chunks(benchmark: DataFrame, window: int = WINDOW, words: int = CHUNK_WORDS) -> DataFrame:
    """(name, text): the items in chunks of so many windows, so that no row is large; every window is in one of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words_of(piece.column(1))
                names, texts = [], []
                for name, a, b in zip(piece.column(0).to_pylist(), w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
                    for k in range(a, max(a + 1, b - window + 1) if b > a else a, words):
                        names.append(name)
                        texts.append(w.raw[w.starts[k] : w.ends[min(b, k + words + window - 1) - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "text"])

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), "text")
    return rows.mapInArrow(work, "name string, text string").distinct()


def benchmark_passes(benchmark: DataFrame, window: int = WINDOW, chars: int = PASS_CHARS) -> list[Callable[[], Phrases]]:
    """The windows of all items, in parts of about `chars` characters of text each, fetched one at a time."""
    chunks = keep(item_chunks(benchmark, window), "chunks")
    parts = max(1, -(-int(chunks.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // chars))
    own = chunks.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)))

    def fetch(part: int) -> Phrases:
        rows = own.filter(F.col("part") == part).select("name", "text").collect()  # a part, of a bounded size
        return phrases_of([r.name for r in rows], [r.text for r in rows], window)

    return [partial(fetch, k) for k in range(parts)]


def op9_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), benchmark_passes(table(spark, sf_dir, "benchmark")), ["doc_id"])
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        ((F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated (a twentieth of their words or more), without the benchmark's windows."""
    own = renamed(docs, "text")
    found = find_passages(own, benchmark_passes(benchmark), own.columns[:-1], clean=True)
    return named(found.filter((F.col("_hit") == 0) | (20 * F.col("_hit") < F.col("_words"))), docs, "_clean")


QUERIES = {"op9_fm_index_decontamination": op9_fm_index_decontamination}
SQL = {"op9_fm_index_decontamination": f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS (
  SELECT item_id, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS win, least(len(w), {WINDOW}) AS n
  FROM items, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
doc_lists AS (SELECT doc_id, list(word ORDER BY pos) AS w FROM words GROUP BY doc_id),
starts AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM doc_lists, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, starts.n, item_id FROM starts JOIN wins ON starts.win = wins.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(l.w), 0) AS contaminated
FROM documents d LEFT JOIN doc_lists l USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""}
