"""Personal data: base spans against plain patterns, exact marginals on a small tree, added spans, odd texts."""

import hashlib
import random
import re
import time

import numpy as np

from parley.llm import personal as pl

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    def fits(k, x):
        digits = re.sub("[^0-9]", "", x)
        if k == 1:
            return all(int(p) <= 255 for p in x.split("."))
        if k == 2:
            return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return k == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if fits(k, m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", "x.y", "+1 (555) 123-4567", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "12", "-", " ", "é", "+", "0", "555-1234", "@a.b", "999", "٣", "(", "001.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pl.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 200_000 + "1", "a@" * 100_000, "1 " * 150_000):
        pl.base_spans(text)
        pl.nodes_of([text], [[]])
    assert time.time() - start < 20


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    k = len(pl.KINDS) + 1
    n = pl.Nodes(*(np.zeros(4, np.int64) for _ in range(4)), rng.normal(size=(4, pl.SHAPES)).astype(np.float32), np.arange(4), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    w = pl.Weights(rng.normal(size=(pl.SHAPES, k)) * 0.3, rng.normal(size=(pl.CONTEXT, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    own, want = n.shape @ w.shape + w.context[n.context], np.zeros((4, k))
    for labels in np.ndindex(k, k, k, k):
        a, b, c, d = labels
        p = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + w.chain[a, b] + w.chain[b, c] + w.skip[b, d])
        for i, x in enumerate(labels):
            want[i, x] += p
    want /= want.sum(1, keepdims=True)
    assert np.allclose(pl.marginals(n, w, rounds=60), want, atol=1e-5)


def test_repeated_tokens_take_the_label(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = [(i, f"{word()} write to {word()}.{i}@mail.example.com or call +1 555 {rng.randint(1000000, 9999999)} about item {rng.randint(10, 99)} and {rng.randint(100, 999)}", "en", "s", 1) for i in range(150)]
    docs += [(900, "ask jane.doe77@mail.example.com first. Later jane.doe77 answers; and item 42 stays", "en", "s", 1), (901, "only numbers 42 and 1234 here", "en", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in pl.found(df, pl.learned(df), ["doc_id"]).collect()}
    text = docs[150][1]
    at = text.index("jane.doe77 answers")
    assert got[900].spans == f"email:4:31,email:{at}:{at + 10}" and got[900].n_added == 1
    assert got[901].spans == "" and sum(got[i].n_added for i in range(150)) == 0


def sample_weights():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [f"{word()} write to {word()}.{i}@mail.example.com or call +1 555 {rng.randint(1000000, 9999999)} about item {rng.randint(10, 99)} and {rng.randint(100, 999)}" for i in range(150)]
    return pl.fitted(pl.nodes_of(texts, [pl.base_spans(t) for t in texts]))


def test_labels_reach_all_repetitions():
    w = sample_weights()
    for many in (1, 2, 30, 300):
        texts = ["ask jane.doe77@mail.example.com first. " + "Later jane.doe77 answers, with many words between them. " * many,
                 "call +1 555 8675309 now. " + "Then again 8675309 is in the list of this text. " * many, "numbers 12345 alone " * many]
        added = pl.added_spans(texts, [pl.base_spans(t) for t in texts], w)
        assert [len(x) for x in added] == [many, many, 0]
        assert {k for _, k, _ in added[0]} == {0} and {k for _, k, _ in added[1]} == {3}


def test_covering_span_behind_many_others():
    text = "a@b.cd " + "4111111111111111@x.com " + "q@x.com " * 20 + "+1 555 8675309 end"
    own = pl.base_spans(text)
    n = pl.nodes_of([text], [own])
    want = [next((k + 1 for a, k, b in own if a < e and s < b), 0) for s, e in zip(n.start.tolist(), n.end.tolist(), strict=True)]
    assert n.label.tolist() == want and want[-1] == 4


def test_base_spans_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pl.op4_skip_chain_field(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pl.written(base).encode()).hexdigest()
        assert set(filter(None, pl.written(base).split(","))) <= set(r.spans.split(","))


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (2, ""), (3, "no candidates"), (None, "a@b.cd"), (4, "@ + 0 " * 20_000), (5, "\U0001f600 1.2.3.4")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], SCHEMA).withColumnRenamed("source", "spans")
    got = [(r.doc_id, r.spans) for r in pl.found(df, pl.learned(df), ["doc_id", "spans"]).collect()]
    assert got == [(1, ""), (2, ""), (2, ""), (3, ""), (None, "email:0:6"), (4, ""), (5, "ip:2:9")]
    assert pl.found(df.limit(0), pl.learned(df.limit(0)), ["doc_id"]).collect() == []


def test_a_repeated_row_is_learned_once(spark):
    docs = [(i, f"write to user{i}@mail.example or call +1 555 867{i:04d}, user{i} said", "en", "s", 1) for i in range(30)]
    once, often = (spark.createDataFrame(x, SCHEMA) for x in (docs, [*docs, *[docs[3]] * 10_000]))
    assert str(pl.learned(once)) == str(pl.learned(often))
    assert pl.learned(often) is not None
