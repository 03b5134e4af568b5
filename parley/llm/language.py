"""Language identification as mixture inference: each document is a mix of languages.

A language is a distribution over byte trigrams (letters lower-cased, anything between words one space), counted over
all labelled documents that may be learned from. A word's likelihood in a language is that of its trigrams. For each
document, expectation-maximisation finds the proportions of the languages that best explain its words; then the
languages are taken in order of their proportions, and the number of them with the best penalised likelihood
(log-likelihood less half the log of the words for each further language) is the document's language set. The prediction is the
set's largest member; its score is its proportion.

Defined cases: `und` with score 0 for null texts, texts without a letter, or when nothing was learned; rows are judged
each, repeated or not; ties go to the language first in order; unknown trigrams count as equally likely everywhere;
languages are learned from every labelled row, whatever its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import named, packed, remainder, renamed, sum_blocks, table, unpacked
from .words import WORD_BYTE, Words, mix, pieces, words_of

BINS = 1 << 16
BLOCK = 1 << 14
ROUNDS = 8
#: The least likelihood of a word in a language, relative to the language that fits it best.
LEAST = 1e-30
SMOOTHING = 0.5

_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_LOWER = np.where(WORD_BYTE, _LOWER, 32).astype(np.uint32)


def grams(w: Words) -> np.ndarray:
    """Bin of the trigram around each byte of a piece; only those inside words are meaningful."""
    n = len(w.raw)
    padded = np.full(n + 2, 32, np.uint32)
    padded[1:-1] = _LOWER[w.raw]
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    code *= np.uint32(0x9E3779B1)
    return (code ^ (code >> np.uint32(15))) >> np.uint32(8) & np.uint32(BINS - 1)


def counted(labelled: DataFrame) -> DataFrame:
    """(block, counts): trigram counts of each language, in blocks named `number language`. Takes (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, langs = words_of(piece.column(1)), piece.column(0).to_pylist()
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                inside = np.flatnonzero(WORD_BYTE[w.raw])
                row = np.searchsorted(w.offsets, inside, "right") - 1 if len(names) > 1 else np.zeros(len(inside), np.int64)
                got = np.bincount(which[row] * BINS + grams(w)[inside], minlength=len(names) * BINS).reshape(-1, BINS)
                for name, counts in zip(names, got, strict=True):
                    total[name] = total[name] + counts if name in total else counts
        for name, counts in total.items():
            for k in range(BINS // BLOCK):
                part = counts[k * BLOCK : (k + 1) * BLOCK].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f"{k} {name}"]), pa.array([packed(part)], pa.binary())], ["block", "counts"])

    return labelled.select("lang", "text").mapInArrow(work, "block string, counts binary")


def learned(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of the trigram bins (bins x languages). One small table a language."""
    blocks = {r.block: unpacked(r.counts) for r in sum_blocks(counted(labelled)).collect()}
    names = sorted({b.split(" ", 1)[1] for b in blocks})
    counts = np.array([np.concatenate([blocks[f"{k} {x}"] for k in range(BINS // BLOCK)]) for x in names], float).reshape(-1, BINS)
    seen = max(1, int((counts.sum(0) > 0).sum())) if len(names) else 1
    logs = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * seen))
    logs[:, counts.sum(0) == 0] = np.log(SMOOTHING / (counts.sum() + SMOOTHING * seen)) if len(names) else 0
    return names, np.ascontiguousarray(logs.T.astype(np.float32))


def has_letter(w: Words) -> np.ndarray:
    """Whether each row has a letter of any alphabet."""
    ascii_letter = np.concatenate([[0], np.cumsum((w.raw | 32) - 97 < 26)])  # uint8 wraps around
    out = ascii_letter[w.offsets[1:]] > ascii_letter[w.offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(w.raw >= 128)])
    for i in np.flatnonzero(~out & (high[w.offsets[1:]] > high[w.offsets[:-1]])).tolist():
        out[i] = any(c.isalpha() for c in w.raw[w.offsets[i] : w.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _mixture(likelihood: np.ndarray, row: np.ndarray, rows: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) after some rounds, and the documents' log-likelihoods. No empty document."""
    sizes = np.diff(rows)
    mix_ = np.full((len(sizes), likelihood.shape[1]), 1 / likelihood.shape[1], np.float32)
    for _ in range(rounds):
        share = likelihood * mix_[row]
        share /= share.sum(1, keepdims=True)
        mix_ = np.add.reduceat(share, rows[:-1], axis=0) / sizes[:, None]
    return mix_, np.add.reduceat(np.log((likelihood * mix_[row]).sum(1)), rows[:-1], dtype=np.float64)


def inferred(w: Words, logs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages; 0 for documents without words) and which languages are in the set."""
    n, langs = len(w.rows) - 1, logs.shape[1]
    proportions, chosen = np.zeros((n, langs)), np.zeros((n, langs), bool)
    some = np.flatnonzero(np.diff(w.rows))
    if not len(some) or not langs:
        return proportions, chosen
    by_byte = logs[grams(w)]
    bounds = np.stack([w.starts, w.ends], 1).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(w.raw) else bounds
    score = np.add.reduceat(by_byte, bounds, axis=0)[::2]
    # relative to the best language of each word; no word counts for nothing in any of them
    likelihood = np.maximum(np.exp(score - score.max(1, keepdims=True)), np.float32(LEAST))
    rows = np.append(w.rows[some], w.rows[-1])
    sizes = np.diff(rows)
    row = np.repeat(np.arange(len(some)), sizes)
    full, _ = _mixture(likelihood, row, rows, rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(sizes, 2))
    best, number = None, np.ones(len(some), np.int64)
    for k in range(1, langs + 1):
        top = np.take_along_axis(likelihood, order[row, :k], 1)
        if k == 1:
            fit = np.add.reduceat(np.log(top[:, 0]), rows[:-1], dtype=np.float64)
        else:
            fit = _mixture(top, row, rows, rounds // 2)[1] - (k - 1) * penalty
        if best is None:
            best = fit
        else:
            better = fit > best
            best, number = np.where(better, fit, best), np.where(better, k, number)
    proportions[some] = full
    for k in range(langs):
        chosen[some[number > k], order[number > k, k]] = True
    return proportions, chosen


def identify(docs: DataFrame, names: list[str], logs: np.ndarray, columns: list[str]) -> DataFrame:
    """`columns` of each document with `_lang`, `_score`, `_languages` (the set, largest first) and `_shares` (theirs)."""
    known = docs.sparkSession.sparkContext.broadcast((names, logs))
    inner = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"))
    out = T.StructType(inner.schema.fields[:-1] + T.StructType.fromDDL("_lang string, _score double, _languages array<string>, _shares array<double>").fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = known.value
        for batch in batches:
            for piece in pieces(batch, "_text"):
                w = words_of(piece.column(piece.num_columns - 1))
                shares, chosen = inferred(w, logs)
                chosen &= has_letter(w)[:, None]
                lang, score, sets, parts = [], [], [], []
                for s, c in zip(shares, chosen, strict=True):
                    own = sorted(np.flatnonzero(c).tolist(), key=lambda i: (-s[i], i))
                    lang.append(names[own[0]] if own else "und")
                    score.append(min(1.0, float(s[own[0]])) if own else 0.0)
                    sets.append([names[i] for i in own])
                    parts.append([min(1.0, float(s[i])) for i in own])
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(lang), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], out.fieldNames())

    return inner.mapInArrow(work, out)


def learn_from(docs: DataFrame) -> DataFrame:
    return docs.filter("lang is not null and text is not null").filter(remainder("doc_id", 4) != 2).select("lang", "text")


def op6_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, *learned(learn_from(docs)), ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
                        F.concat_ws(",", "_languages").alias("languages"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language can be told; those with `und` go."""
    own = renamed(docs, "text")
    found = identify(own, *learned(learn_from(docs)), own.columns[:-1])
    return named(found.filter("_lang <> 'und'"), docs)


QUERIES = {"op6_mixture_language": op6_mixture_language}
SQL = {}
