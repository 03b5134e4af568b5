"""The classifier: held-out quality, a plain forward pass, odd documents."""

import zlib

import numpy as np
import pytest

from parley.llm import toxicity as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = tx.op2_convolutional_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    hits = sum(p == 1 and y == 1 for p, _, y in held)
    # some of the few labels at this size stand on texts without any mark
    assert hits / sum(y for *_, y in held) > 0.8 and hits / max(1, sum(p for p, *_ in held)) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_pass_equals_a_plain_one():
    rng = np.random.default_rng(4)
    model = tx.trained([], np.zeros(0))
    model.offsets = [rng.normal(size=tx.FILTERS).astype(np.float32) for _ in tx.WIDTHS]
    sizes = [0, 1, 2, 7, 0, 3]
    bins = rng.integers(0, tx.BINS, (sum(sizes), 3)).astype(np.int32)
    rows = np.concatenate([[0], np.cumsum(sizes)])
    got = tx.logits(model, bins, rows)
    for r, n in enumerate(sizes):
        x = [model.embeddings[bins[i]].sum(0) for i in range(rows[r], rows[r + 1])] + [np.zeros(tx.DIM)] * 2
        pooled = []
        for k, width in enumerate(tx.WIDTHS):
            outs = [np.concatenate(x[i : i + width]) @ model.filters[k] + model.offsets[k] for i in range(n)]
            pooled += list(np.max(outs, axis=0)) if outs else [0] * tx.FILTERS
        assert got[r] == pytest.approx(float(np.maximum(pooled, 0) @ model.weights), abs=1e-4)


def test_thresholds_part_the_labels():
    assert 2 < tx.threshold(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1]), np.ones(4)) < 3


def test_odd_documents(spark):
    rows = [(i, ("good text here " * 5) + ("nasty " if i % 2 else "fine "), "en", "s", 1) for i in range(200)]
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "!!", "en", "s", 0), (None, "nasty", None, None, None), (903, "word " * 60_000 + "nasty", "en", "s", 0), (1, rows[1][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumnRenamed("source", "_score")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(900, 1, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r._score) for r in tx.scored(docs, tx.learned(docs, labels), ["doc_id"]).collect()]
    by = dict(got)
    assert len(got) == 206 and all((by[i] >= 0.5) == bool(i % 2) for i in range(200))
    assert by[900] == by[901] == by[902] == pytest.approx(0.5, abs=0.1) and by[None] > 0.5 and by[903] > 0.5


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.scored(docs, tx.learned(docs, none), ["doc_id"]).first()._score < 1e-6
    assert tx.scored(docs.limit(0), tx.learned(docs.limit(0), none), ["doc_id"]).collect() == []


def test_a_repeated_row_is_learned_once(spark):
    docs = [(i, f"plain text number {i} with words" if i % 2 else f"nasty mark text {i} badword", "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(docs, SCHEMA)
    often = spark.createDataFrame([*docs, *[docs[3]] * 10_000, (3, "zzz a larger text of the same id", "de", "s", 1)], SCHEMA)
    a, b = tx.learned(once, labels), tx.learned(often, labels)
    assert all((getattr(a, n) == getattr(b, n)).all() for n in ("embeddings", "weights", "thresholds"))


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(tx, "CHUNK", 100)  # several shards
    docs = [(i, f"plain text number {i % 7} with words" if i % 20 else "odd nasty mark badword", "en", "s", 1) for i in range(6000)]
    docs = [(i, f"word{i}x {t}", *rest) for i, t, *rest in docs]
    labels = spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i in range(6000)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, SCHEMA)
    seen = []
    kept = tx.fitted
    monkeypatch.setattr(tx, "fitted", lambda rows, share: seen.append(rows.count()) or kept(rows, share))
    model = tx.learned(frame, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(6000))]
    got = tx.scored(frame, model, ["doc_id"]).collect()
    assert all((r._score >= 0.5) == (r.doc_id % 20 == 0) for r in got)


def test_texts_without_a_label_stay_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in [None, *range(4000)]], SCHEMA).select("doc_id", "lang", "text")
    marked = spark.createDataFrame([(i, 1) for i in range(0, 4000, 100)], "_id long, _toxic int")
    found = [r.doc_id for r in tx.maybe_marked(docs, marked, 40).collect()]
    assert set(range(0, 4000, 100)) <= set(found) and len(found) == len(set(found)) < 60


def test_shards_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(tx, "CHUNK", 10)
    seen, before = [], tx.after_round
    monkeypatch.setattr(tx, "after_round", lambda rows, *rest: seen.append((rows, rows.storageLevel.useDisk)) or before(rows, *rest))
    docs = [(i, f"word{i % 7} plain text" if i % 3 else "odd nasty mark", "en", "s", 1) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    tx.learned(spark.createDataFrame(docs, SCHEMA), labels)
    assert len(seen) == tx.ROUNDS and all(rows is seen[0][0] and kept for rows, kept in seen)
    assert not seen[0][0].storageLevel.useDisk  # released


def test_bins_are_kept_whole():
    bins = np.random.default_rng(1).integers(0, tx.BINS, (1000, 3)).astype(np.int32)
    bins[0] = tx.BINS - 1
    assert (tx.bins_of(tx.bytes_of(bins)) == bins).all() and len(tx.bytes_of(bins)) < 6200
    assert tx.bins_of(tx.bytes_of(bins[:0])).shape == (0, 3)


def test_a_batch_without_words_is_learned_from():
    state = tx.begun()
    before = state["embeddings"].copy()
    tx.descend(state, [np.zeros((0, 3), np.int32)], np.ones(1), np.random.default_rng(1))
    assert (state["embeddings"] == before).all() and state["bias"][0] > 0
