"""Personal data: a skip-chain conditional random field over the tokens of each document.

Base spans are found by four patterns (email, ip, card, phone). The nodes of the field are the tokens (between white
space, without punctuation around them) that hold a digit, an @ or a +, and the words that equal an email's local part.
A node's own potential comes from its shape and the word before it; neighbouring nodes share a transition potential.
Skip edges join the occurrences of equal or similar tokens, however far apart: the same token, the same last seven
digits, an email and its local part. They go from each occurrence to a hub of what they share, so any two are two hops
apart and a token that stands a thousand times adds a thousand edges. A hub has only the labels of base spans among its
occurrences, if there are any, so that many repetitions can't outvote the one that a pattern matches. Loopy sum-product
messages then carry labels along both kinds of edges until they stop changing, and a token that no pattern matches takes
the label that its repetitions have. Messages of a document that still change after `ROUNDS` are taken as they are. Nodes with a label of probability `SURE` or more that no base
span covers are added to the base spans, which all stay.

Weights of shapes, contexts and transitions are fitted by pseudo-likelihood on a bounded sample (`SAMPLE` documents with
candidates, the first by a hash of text and id), whose labels are the base spans. These can't say how far repetitions
agree, as no pattern matches the tokens that only a repetition gives away; the skip potential is a fixed `AGREE`.

Defined cases: null texts are empty; a text without candidates has no spans; rows are read each, repeated or not; without
base spans in the sample nothing is added; patterns are searched in time linear in the text, also in long runs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1000
SURE = 0.5
ROUNDS = 200
SETTLED = 1e-6
AGREE = 8.0
CONTEXT = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@+]")
_ANY = re.compile(r"[0-9@]")
_AROUND = ".,;:!?()[]{}\"'<>"


# -- base spans ------------------------------------------------------------------------------------------------------


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind."""
    out = []
    if "@" in text:
        behind = 0  # an address can't begin before the end of the last
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > behind and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                behind = m.end()
    if _ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


# -- the field -------------------------------------------------------------------------------------------------------


@dataclass
class Nodes:
    """The nodes of some documents, one after the other."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  #: 0, or the base span's kind + 1
    shape: np.ndarray  #: nodes x features
    context: np.ndarray  #: bin of the word before
    chain: np.ndarray  #: edges x 2
    skip: np.ndarray  #: edges x 2, to nodes or to hubs, which are numbered behind the nodes
    hubs: np.ndarray | None = None  #: hubs x labels: the labels that base spans give its occurrences


_DIGITS_UP_TO = (0, 3, 6, 8, 11, 15, 19)
SHAPES = 12 + len(_DIGITS_UP_TO) + 1


def _shape(token: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    out = [1.0, "@" in token, "@" in token and "." in token.rpartition("@")[2], token.startswith("+"), token.count(".") == 3, "-" in token, "(" in token or ")" in token,
           letters == 0, letters > 0 and digits > 0, digits == 0, len(token) > 24, digits == len(token)]
    return [*map(float, out), *(float(i == np.searchsorted(_DIGITS_UP_TO, digits)) for i in range(len(_DIGITS_UP_TO) + 1))]


def _bin(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=2).digest()) % CONTEXT


def _keys(token: str, digits: int, locals_: set[str]) -> list[str]:
    """What a token has in common with those it is joined to."""
    if "@" in token:
        local = token.partition("@")[0].lower()
        return [token.lower(), local] if len(local) >= 4 else [token.lower()]
    if token.lower() in locals_:
        return [token.lower()]
    if digits >= 7:
        return [token.lower(), "#" + _digits(token)[-7:]]
    return [token.lower()] if digits >= 5 or "." in token and digits >= 4 else []


def nodes_of(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Nodes:
    doc, start, end, label, shape, context, chain, joined = [], [], [], [], [], [], [], []
    for d, (text, own) in enumerate(zip(texts, spans, strict=True)):
        if not _CANDIDATE.search(text):
            continue
        locals_ = {x for s, k, e in own if k == 0 and len(x := text[s:e].partition("@")[0].lower()) >= 4}
        members: dict[str, list[int]] = {}
        starts, reach = [a for a, _, _ in own], list(accumulate((b for _, _, b in own), max))
        before, at, place = "", 0, -9
        for m in _TOKEN.finditer(text):
            whole = m[0]
            place += 1
            if _CANDIDATE.search(whole) or (locals_ and whole.strip(_AROUND).lower() in locals_):
                left = whole.lstrip(_AROUND)
                token = left.rstrip(_AROUND)
                if token:
                    s = m.end() - len(left)
                    e = s + len(token)
                    # the first span that ends behind the token's start
                    first = bisect_right(reach, s)
                    cover = own[first][1] + 1 if first < len(own) and starts[first] < e else 0
                    i = len(doc)
                    if len(start) and doc[-1] == d and place - at <= 2:
                        chain.append((i - 1, i))
                    at = place
                    digits = sum("0" <= c <= "9" for c in token)
                    for key in _keys(token, digits, locals_):
                        if (same := members.setdefault(key, []))[-1:] != [i]:
                            same.append(i)
                    doc.append(d)
                    start.append(s)
                    end.append(e)
                    label.append(cover)
                    shape.append(_shape(token))
                    context.append(_bin(before.strip(_AROUND)))
            before = whole
        joined += [same for same in members.values() if len(same) > 1]
    hubs = np.zeros((len(joined), len(KINDS) + 1), bool)
    for k, same in enumerate(joined):
        hubs[k, [label[i] for i in same if label[i]]] = True
    skip = [(i, len(doc) + k) for k, same in enumerate(joined) for i in same]
    edges = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Nodes(*(np.array(x, np.int64) for x in (doc, start, end, label)), np.array(shape, np.float32).reshape(-1, SHAPES), np.array(context, np.int64), edges(chain), edges(skip), hubs)


@dataclass
class Weights:
    shape: np.ndarray  #: features x labels
    context: np.ndarray  #: bins x labels
    chain: np.ndarray  #: labels x labels
    skip: np.ndarray


def _own(n: Nodes, w: Weights) -> np.ndarray:
    return n.shape @ w.shape + w.context[n.context]


def fitted(n: Nodes, steps: int = 300, rate: float = 0.2, decay: float = 1e-3) -> Weights | None:
    """Weights that make each node's label likely given its neighbours' labels."""
    labels, total = len(KINDS) + 1, len(n.label)
    if not total or not (n.label > 0).any():
        return None
    w = Weights(np.zeros((SHAPES, labels)), np.zeros((CONTEXT, labels)), np.zeros((labels, labels)), AGREE * np.eye(labels))
    truth = np.eye(labels)[n.label]
    past = [np.full(x.shape, 1e-8) for x in (w.shape, w.context, w.chain)]
    # rare labels count as much as the frequent one
    weight = (total / labels / np.maximum(1, np.bincount(n.label, minlength=labels)))[n.label]
    weight = np.minimum(weight, 50) / total
    for _ in range(steps):
        score = _own(n, w)
        np.add.at(score, n.chain[:, 1], w.chain[n.label[n.chain[:, 0]]])
        np.add.at(score, n.chain[:, 0], w.chain.T[n.label[n.chain[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = (p / p.sum(1, keepdims=True) - truth) * weight[:, None]
        context = np.zeros_like(w.context)
        np.add.at(context, n.context, miss)
        forth, back = np.zeros((labels, labels)), np.zeros((labels, labels))
        np.add.at(forth, n.label[n.chain[:, 0]], miss[n.chain[:, 1]])
        np.add.at(back, n.label[n.chain[:, 1]], miss[n.chain[:, 0]])
        gradients = [n.shape.T @ miss, context, forth + back.T]
        for value, g, old in zip((w.shape, w.context, w.chain), gradients, past, strict=True):
            g = g + decay * value
            old += g * g
            value -= rate * g / np.sqrt(old)
    return w


def marginals(n: Nodes, w: Weights, rounds: int = ROUNDS, given: float = 6.0) -> np.ndarray:
    """Label probabilities by loopy sum-product; the base spans' labels are given as strong evidence."""
    labels, nodes = len(KINDS) + 1, len(n.label)
    own = _own(n, w) + given * np.eye(labels)[n.label] * (n.label > 0)[:, None]
    if n.hubs is not None and len(n.hubs):
        own = np.concatenate([own, np.where(n.hubs.any(1, keepdims=True) & ~n.hubs, -100.0, 0.0)])
    edges = np.concatenate([n.chain, n.skip])
    pair = np.concatenate([np.repeat(w.chain[None], len(n.chain), 0), np.repeat(w.skip[None], len(n.skip), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))  # source label x target label
    m, half = np.zeros((len(source), labels)), len(edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    doc = np.tile(n.doc[edges[:, 0]], 2)  # an edge begins at a node, not at a hub
    live = np.arange(len(source))
    for _ in range(rounds):
        if not len(live):
            break
        belief = own.copy()
        np.add.at(belief, target[live], m[live])
        out = belief[source[live]] - m[back[live]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("es,est->et", out, pair[live]))
        new = 0.5 * m[live] + 0.5 * (new - new.max(1, keepdims=True))
        moving = np.unique(doc[live[np.abs(new - m[live]).max(1) > SETTLED]])
        m[live] = new
        live = live[np.isin(doc[live], moving)]
    belief = own.copy()
    np.add.at(belief, target, m)
    p = np.exp(belief - belief.max(1, keepdims=True))[:nodes]
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str], spans: list[list[tuple[int, int, int]]], w: Weights | None) -> list[list[tuple[int, int, int]]]:
    """For each text, the spans of nodes that the field labels and no base span covers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if w is None:
        return out
    n = nodes_of(texts, spans)
    if len(n.doc):
        p = marginals(n, w)
        best = p.argmax(1)
        for i in np.flatnonzero((best > 0) & (p.max(1) >= SURE) & (n.label == 0)).tolist():
            out[n.doc[i]].append((int(n.start[i]), int(best[i]) - 1, int(n.end[i])))
    return out


# -- on Spark --------------------------------------------------------------------------------------------------------


def learned(docs: DataFrame, sample: int = SAMPLE) -> Weights | None:
    texts = docs.select(F.xxhash64("doc_id", "text").alias("_h"), "text").filter(F.col("text").rlike("[0-9@+]"))
    chosen = F.broadcast(texts.select("_h").distinct().orderBy("_h").limit(sample))  # at most `sample` numbers
    one = texts.join(chosen, "_h").groupBy("_h").agg(F.min("text").alias("text"))  # rows that repeat come once
    rows = sorted({r.text for r in one.select("text").collect()})
    return fitted(nodes_of(rows, [base_spans(t) for t in rows]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs: DataFrame, w: Weights | None, columns: list[str]) -> DataFrame:
    """`columns` and n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row."""
    known = docs.sparkSession.sparkContext.broadcast(w)
    columns = [c for c in columns if c not in {"base_sha256", "spans", "n_added", *(f"n_{k}" for k in KINDS)}]
    inner = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce("text", F.lit("")).alias("_text"))
    out = inner.drop("_text").schema
    for k in KINDS:
        out = out.add(f"n_{k}", "long")
    out = out.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, known.value)
                counts = [[sum(s[1] == k for s in b) for b in base] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                     pa.array([written(b + m) for b, m in zip(base, more, strict=True)], pa.string()), pa.array([len(m) for m in more], pa.int64())], out.fieldNames())

    return inner.mapInArrow(work, out)


def op4_skip_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, learned(docs), ["doc_id"])


QUERIES = {"op4_skip_chain_field": op4_skip_chain_field}
SQL = {}
