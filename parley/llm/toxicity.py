"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three hashed ones: of the word and of its first four and five bytes, so that unseen
forms of a stem are known. Filters of widths 1, 2 and 3 slide over the embeddings; each one's maximum over the whole
text, if positive, enters a logistic layer. Training is on all labelled documents: embeddings, filters and the last layer
by gradient steps on mini-batches. Documents are dealt out to shards by a hash of the id; each round the shards go on
from one state on their own, a chunk of documents at a time, and the mean of their states is the next one. Only texts
that may have a label are brought to their labels, and shards are dealt out once for all rounds.

Thresholds are calibrated by language on the fifth of the labelled documents that training leaves out, from counts of
their logits. A text's language is guessed from its words (naive Bayes over their bins, learned from all labelled
documents); the logit less its language's threshold
gives the score, so that 0.5 is the threshold everywhere. Language, source, labels and ids are no inputs of a score.

Defined cases: null texts and texts without words get the share of label 1 among labelled rows; so do all texts if
there are no labelled rows of both kinds (0 without any); rows are scored each; documents labelled several times count with
their largest label; labels other than 0 and 1 are left out. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .tables import Filter, keep, remainder, table
from .words import Words, pieces, run_hashes, words_of

#: Labelled documents, and their words, that a task learns from at a time; documents a shard has at least; most shards.
CHUNK, CHUNK_WORDS, SHARDS = 4000, 1 << 22, 64
#: Up to so many documents each is met EPOCHS times, of more ones proportionally less often, twice at least.
FULL = 16_000
#: Times that the shards' states are averaged, at most.
ROUNDS = 4
#: Steps of a logit, where thresholds are looked for.
CELLS = 64
BINS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 20
BATCH = 32
INITIAL, RATE = 0.02, 0.1
#: Share of a text's words that a training step leaves out, so that no single word is learned by heart.
DROPPED = 0.5


def word_bins(w: Words) -> np.ndarray:
    """(words x 3) bins: the word's and those of its beginnings."""
    out = np.empty((len(w.hashes), 3), np.int32)
    out[:, 0] = (w.hashes >> np.uint64(40)).astype(np.int64) % BINS
    lower = w.raw | np.where((w.raw >= 65) & (w.raw <= 90), 32, 0).astype(np.uint8)
    for k, size in ((1, 4), (2, 5)):
        beginnings = run_hashes(lower, w.starts, np.minimum(w.ends, w.starts + size))
        out[:, k] = (beginnings >> np.uint64(40 + k)).astype(np.int64) % BINS
    return out


@dataclass
class Model:
    embeddings: np.ndarray  #: bins x dim
    filters: list[np.ndarray]  #: for each width: (width * dim) x filters
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: np.ndarray  #: bins x languages, log-probabilities of words
    thresholds: np.ndarray  #: by language
    share: float = 0.0  #: of label 1 among labelled rows


def features(model: Model, bins: np.ndarray, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Pooled maxima (rows x all filters), their places if asked for, and the padded embeddings. Two zero embeddings
    stand behind each row's words."""
    n, sizes, pad = len(rows) - 1, np.diff(rows), max(WIDTHS) - 1
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(bins)) + pad * row
    x = np.zeros((len(bins) + pad * n + 1, DIM), np.float32)  # one more, as a row without words has place 0
    x[place] = model.embeddings[bins[:, 0]] + model.embeddings[bins[:, 1]] + model.embeddings[bins[:, 2]]
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    places = np.zeros((n, len(WIDTHS) * FILTERS), np.int64) if where else None
    some = np.flatnonzero(sizes)
    if not len(some):
        return pooled, places, x
    for k, width in enumerate(WIDTHS):
        out = np.tile(model.offsets[k], (len(place), 1))
        for i in range(width):
            out += x[place + i] @ model.filters[k][i * DIM : (i + 1) * DIM]
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        pooled[some, own] = np.maximum.reduceat(out, rows[:-1][some], axis=0)
        if where:
            for r in some:
                places[r, own] = place[rows[r] + out[rows[r] : rows[r + 1]].argmax(0)]
    return pooled, places, x


def logits(model: Model, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.maximum(features(model, bins, rows)[0], 0) @ model.weights + model.bias


def guessed(model: Model, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of each row's likeliest language."""
    out = np.zeros(len(rows) - 1, np.int64)
    some = np.flatnonzero(np.diff(rows))
    if len(some) and model.languages.shape[1]:
        out[some] = np.add.reduceat(model.languages[bins[:, 0]], rows[:-1][some], axis=0).argmax(1)
    return out


State = dict[str, np.ndarray]
#: Bins of one part of the embeddings, when parts are averaged.
PART = BINS // 8


def begun(seed: int = 7) -> State:
    """What training changes: parameters, and the sums of their squared gradients (`past ...`; a bin has one)."""
    rng = np.random.default_rng(seed)
    state = {"embeddings": (rng.normal(size=(BINS, DIM)) * INITIAL).astype(np.float32)}
    state |= {f"filter {k}": (rng.normal(size=(w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for k, w in enumerate(WIDTHS)}
    state |= {f"offset {k}": np.zeros(FILTERS, np.float32) for k in range(len(WIDTHS))}
    state |= {"weights": (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32), "bias": np.zeros(1, np.float32)}
    past = {f"past {name}": np.full(value.shape, 1e-6, np.float32) for name, value in state.items() if name != "embeddings"}
    return state | past | {"past embeddings": np.full(BINS, 1e-6, np.float32)}


def as_model(state: State) -> Model:
    each = range(len(WIDTHS))
    return Model(state["embeddings"], [state[f"filter {k}"] for k in each], [state[f"offset {k}"] for k in each], state["weights"], float(state["bias"][0]), np.zeros((BINS, 0), np.float32), np.zeros(1))


def descend(state: State, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Gradient descent over the texts once, in place, with steps scaled by the past gradients (Adagrad). Only the words
    under a maximum, and the filters, get a gradient."""
    model, squares = as_model(state), state["past embeddings"]

    def step(name: str, gradient: np.ndarray, rate: float) -> None:
        total = state[f"past {name}"]
        total += gradient * gradient
        state[name] -= (rate * gradient / np.sqrt(total)).astype(np.float32)

    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        seen = [texts[i][rng.random(len(texts[i])) >= DROPPED] for i in own]
        bins = np.concatenate(seen)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in seen])])
        pooled, places, x = features(model, bins, rows, where=True)
        active = np.maximum(pooled, 0)
        miss = (1 / (1 + np.exp(-(active @ model.weights + state["bias"][0]))) - labels[own]).astype(np.float32) / len(own)
        back = miss[:, None] * model.weights * (pooled > 0)
        step("weights", active.T @ miss, 0.05)
        step("bias", miss.sum(keepdims=True), 0.05)
        pad, place_bins = max(WIDTHS) - 1, np.full((len(x), 3), -1, np.int64)
        place_bins[np.arange(len(bins)) + pad * np.repeat(np.arange(len(own)), np.diff(rows))] = bins
        ids, gradients = [], []
        for k, width in enumerate(WIDTHS):
            f = slice(k * FILTERS, (k + 1) * FILTERS)
            b, p = back[:, f], places[:, f]
            step(f"offset {k}", b.sum(0), 0.05)
            change = np.zeros_like(model.filters[k])
            for i in range(width):
                change[i * DIM : (i + 1) * DIM] = np.einsum("rf,rfd->df", b, x[p + i])
                ids.append(place_bins[p + i].reshape(-1, 3))
                gradients.append((b[:, :, None] * model.filters[k][i * DIM : (i + 1) * DIM].T).reshape(-1, DIM))
            step(f"filter {k}", change, 0.05)
        ids, gradients = np.concatenate(ids), np.concatenate(gradients)
        real = (ids[:, 0] >= 0) & np.any(gradients != 0, axis=1)
        flat, gradients = ids[real].ravel(), np.repeat(gradients[real], 3, axis=0)
        if len(flat):
            distinct, which = np.unique(flat, return_inverse=True)
            total = np.zeros((len(distinct), DIM), np.float32)
            np.add.at(total, which, gradients)
            squares[distinct] += (total * total).mean(1)
            model.embeddings[distinct] -= RATE * total / np.sqrt(squares[distinct])[:, None]


def trained(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int | None = None) -> Model:
    """A model of texts at hand."""
    state, rng = begun(seed), np.random.default_rng(seed)
    for _ in range(epochs or EPOCHS):
        descend(state, texts, labels, rng)
    return as_model(state)


def bytes_of(bins: np.ndarray) -> bytes:
    """A text's bins, which are below 2**16, compressed."""
    return zlib.compress(bins.astype(np.uint16).tobytes(), 1)


def bins_of(part: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(part), np.uint16).astype(np.int32).reshape(-1, 3)


def together(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the rows, one after the other, and where rows begin."""
    return np.concatenate([np.zeros((0, 3), np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def after_round(rows: DataFrame, state: State, epochs: int) -> State:
    """The state after every shard of `rows` (shard, toxic, bins; the rows of a shard stand together) has gone on from it
    on its own: the mean of the shards; that of a bin is taken over the shards that have met it."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(state)

    def given(own: State) -> Iterator[tuple[str, bytes]]:
        for name, value in own.items():
            if name not in ("embeddings", "past embeddings"):
                yield name, value.tobytes()
        both = np.column_stack([own["embeddings"], own["past embeddings"]])
        for at in range(0, BINS, PART):
            yield f"part {at}", both[at : at + PART].tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(own: State) -> pa.RecordBatch:
            names, values = zip(*given(own), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.binary())], ["name", "value"])

        shard, own, rng, texts, labels, words = None, {}, np.random.default_rng(0), [], [], 0

        def learn() -> None:
            for _ in range(epochs):
                descend(own, texts, np.array(labels, float), rng)

        for batch in batches:
            for number, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("shard", "toxic", "bins")), strict=True):
                if number != shard or len(texts) == CHUNK or words > CHUNK_WORDS:
                    if texts:
                        learn()
                    texts, labels, words = [], [], 0
                if number != shard:
                    if shard is not None:
                        yield batch_of(own)
                    shard, rng = number, np.random.default_rng(number)
                    own = {name: value.copy() for name, value in known.value.items()}
                texts.append(bins_of(part))
                labels.append(toxic)
                words += len(texts[-1])
        if texts:
            learn()
        if shard is not None:
            yield batch_of(own)

    def mean(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        (name,) = key
        values = np.stack([np.frombuffer(v, np.float32) for v in sorted(found["value"])])
        if not name.startswith("part "):
            out = values.mean(0)
        else:
            at, values = int(name.split()[1]), values.reshape(len(values), PART, DIM + 1)
            old = np.column_stack([known.value["embeddings"], known.value["past embeddings"]])[at : at + PART]
            met = (values[:, :, DIM] != old[:, DIM])[:, :, None]
            out = np.where(met.any(0), (values * met).sum(0) / np.maximum(met.sum(0), 1), old)
        return pd.DataFrame({"name": [name], "value": [out.astype(np.float32).tobytes()]})

    parts = rows.mapInArrow(work, "name string, value binary").groupBy("name").applyInPandas(mean, "name string, value binary")
    found = {r["name"]: np.frombuffer(r.value, np.float32) for r in parts.collect()}  # one state, of fixed size
    known.unpersist()
    out = {name: found[name].reshape(value.shape).copy() for name, value in state.items() if name in found}
    both = np.concatenate([found[f"part {at}"].reshape(PART, DIM + 1) for at in range(0, BINS, PART)])
    return out | {"embeddings": both[:, :DIM].copy(), "past embeddings": both[:, DIM].copy()}


def threshold(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of least weighted error."""
    z, which = np.unique(z, return_inverse=True)
    ones, zeros = (np.bincount(which, np.where(labels == k, weights, 0), len(z)) for k in (1, 0))
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    errors = np.concatenate([[0], np.cumsum(ones - zeros)]) + zeros.sum()
    gaps = np.concatenate([[1], z[1:] - z[:-1], [1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(cuts[best[gaps[best].argmax()]])


def word_numbers(rows: DataFrame) -> DataFrame:
    """lang, bin, n: how often words of a bin stand in the texts of a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(BINS, np.int64))
                counts[lang] += np.bincount(bins_of(part)[:, 0], minlength=BINS)
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "bin", "n"])

    own = rows.filter(F.col("lang").isNotNull()).select("lang", "bins")
    return own.mapInArrow(work, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def cells(rows: DataFrame, model: Model) -> DataFrame:
    """guess, cell, toxic, left_out, n: rows by guessed language and logit, in steps of 1 / CELLS and at most 64 off 0."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, begins = together([bins_of(b) for b in batch.column(2).to_pylist()])
            z, guess = logits(known.value, bins, begins), guessed(known.value, bins, begins)
            cell = np.rint(np.clip(z, -64, 64) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(guess.astype(np.int32)), pa.array(cell), batch.column(0), batch.column(1)], ["guess", "cell", "toxic", "left_out"])

    found = rows.select("toxic", "left_out", "bins").mapInArrow(work, "guess int, cell int, toxic int, left_out boolean")
    return found.groupBy("guess", "cell", "toxic", "left_out").agg(F.count("*").alias("n"))


def fitted(rows: DataFrame, share: float) -> Model:
    """A model trained on four fifths of `rows` (id, toxic, lang, bins, order, left_out), its thresholds set on the rest;
    `share` is that of label 1 among all labelled rows."""
    numbers = {(r.toxic, r.left_out): r["count"] for r in rows.groupBy("toxic", "left_out").count().collect()}
    ones, n = sum(v for (toxic, _), v in numbers.items() if toxic == 1), sum(numbers.values())
    if not 0 < ones < n:
        flat = as_model(begun())
        flat.share = ones / n if n else 0.0
        p = min(max(flat.share, 1e-9), 1 - 1e-9)
        flat.weights[:], flat.bias = 0, float(np.log(p / (1 - p)))
        return flat
    own = sum(v for (_, out), v in numbers.items() if not out)
    shards = min(max(1, own // CHUNK), SHARDS)
    epochs = min(max(2, EPOCHS * FULL // max(own, 1)), EPOCHS)
    rounds = 1 if shards == 1 else min(epochs, ROUNDS)
    state, inner = begun(), rows.filter(~F.col("left_out")).withColumn("shard", F.pmod(F.shiftright("order", 8), F.lit(shards)).cast("int"))
    # on disk for all rounds, or each would shuffle it again
    dealt = inner.repartition(shards, "shard").sortWithinPartitions("shard", "order", "id").select("shard", "toxic", "bins").persist(StorageLevel.DISK_ONLY)
    for _ in range(rounds if own else 0):
        state = after_round(dealt, state, -(-epochs // rounds))
    dealt.unpersist()
    model = as_model(state)
    counted = word_numbers(rows).toPandas()
    names = sorted(set(counted["lang"]))
    counts = np.full((BINS, len(names)), 0.1)
    counts[counted["bin"].to_numpy(int), [names.index(x) for x in counted["lang"]]] += counted["n"].to_numpy(float)
    model.languages = np.log(counts / counts.sum(0)).astype(np.float32)
    found = cells(rows, model).toPandas()

    def cut(part: pd.DataFrame) -> float | None:
        both = part["toxic"].nunique() == 2
        return threshold(part["cell"].to_numpy(float) / CELLS, part["toxic"].to_numpy(), part["n"].to_numpy(float)) if both else None

    left_out = found[found["left_out"]]
    whole = cut(left_out) if left_out["toxic"].nunique() == 2 else cut(found)
    cuts = []
    for k in range(max(1, len(names))):
        part = left_out[left_out["guess"] == k]
        least = min(part.loc[part["toxic"] == t, "n"].sum() for t in (0, 1))
        cuts.append(cut(part) if least >= 10 else whole)  # too few to tell: the threshold of all
    model.thresholds, model.share = np.array(cuts), share
    return model


def maybe_marked(docs: DataFrame, marked: DataFrame, members: int) -> DataFrame:
    """The rows of docs whose doc_id is one of `_id`, and rarely others: most texts without a label need not be shuffled."""

    def number(column: str) -> Column:
        return F.xxhash64(F.col(column).cast("string"))

    names, known = docs.columns, docs.sparkSession.sparkContext.broadcast(Filter(marked.select(number("_id")), members))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = known.value.passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(passed))

    return docs.withColumn("_number", number("doc_id")).mapInArrow(work, docs.schema)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows with crc32(doc_id) mod 5 other than 0."""
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").filter(remainder("doc_id", 5) != 0)
    marked = keep(marked.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")), "marked")
    numbers = {r._toxic: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    total = sum(numbers.values())
    inner = maybe_marked(docs.select("doc_id", lang.alias("lang"), "text"), marked, total).join(marked, F.col("doc_id") == F.col("_id"))
    # one text for an id, however often it stands there: the smallest
    inner = inner.groupBy("_id", "_toxic").agg(F.min(F.struct("text", "lang")).alias("_row")).select("_id", "_toxic", "_row.lang", "_row.text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words_of(piece.column(3))
                bins = word_bins(w)
                parts = [bytes_of(bins[a:b]) for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(parts, pa.binary())], ["id", "toxic", "lang", "bins"])

    rows = inner.mapInArrow(work, f"id {labels.schema['doc_id'].dataType.simpleString()}, toxic int, lang string, bins binary")
    order = F.xxhash64("id")
    rows = keep(rows.withColumn("order", order).withColumn("left_out", F.pmod(order, F.lit(5)) == 4), "labelled")
    return fitted(rows, numbers.get(1, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` and `_score` of each row."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"))
    out = inner.drop("_text").schema.add("_score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            for piece in pieces(batch, "_text", 1 << 20):
                w = words_of(piece.column(piece.num_columns - 1))
                bins = word_bins(w)
                z = logits(model, bins, w.rows) - model.thresholds[guessed(model, bins, w.rows)]
                score = np.where(np.diff(w.rows) > 0, 1 / (1 + np.exp(-np.clip(z.astype(float), -700, 700))), model.share)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(score)], out.fieldNames())

    return inner.mapInArrow(work, out)


def op2_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, learned(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_convolutional_toxicity": op2_convolutional_toxicity}
SQL = {}
