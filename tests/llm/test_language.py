"""Language mixtures: held-out accuracy, a plain version of the inference, odd documents."""

import math

import numpy as np
import pyarrow as pa

from parley.llm import language as lg
from parley.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = lg.op6_mixture_language(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_equals_a_plain_version():
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(lg.BINS) * 0.1, 3) + 1e-9).T.astype(np.float32)
    text = "some words of a text that has ten words exactly"
    w = W.words_of(pa.array([text]))
    shares, _ = lg.inferred(w, logs)
    bins, p = lg.grams(w), [1 / 3] * 3
    like = [[math.exp(sum(float(logs[bins[i], k]) for i in range(a, b)) / 1) for k in range(3)] for a, b in zip(w.starts, w.ends, strict=True)]
    for _ in range(lg.ROUNDS):
        parts = [[p[k] * x[k] / sum(p[j] * x[j] for j in range(3)) for k in range(3)] for x in like]
        p = [sum(x[k] for x in parts) / len(parts) for k in range(3)]
    assert np.allclose(shares[0], p, atol=1e-4)


def plain_set(like, rounds):
    """The set of languages: of the largest shares, as many as fit best, each beyond the first at a price."""
    langs = len(like[0])

    def em(chosen, rounds):
        p = {k: 1 / len(chosen) for k in chosen}
        for _ in range(rounds):
            parts = [{k: p[k] * x[k] / sum(p[j] * x[j] for j in chosen) for k in chosen} for x in like]
            p = {k: sum(x[k] for x in parts) / len(parts) for k in chosen}
        return p, sum(math.log(sum(p[k] * x[k] for k in chosen)) for x in like)

    shares = em(list(range(langs)), rounds)[0]
    order = sorted(shares, key=lambda k: -shares[k])
    fits = [em(order[:n], rounds // 2)[1] - (n - 1) * 0.5 * math.log(max(len(like), 2)) for n in range(1, langs + 1)]
    return set(order[: 1 + max(range(langs), key=lambda n: fits[n])])


def test_sets_equal_the_best_of_all_prefixes():
    rng = np.random.default_rng(11)
    logs = np.log(rng.dirichlet(np.ones(lg.BINS) * 0.05, 4) + 1e-9).T.astype(np.float32)
    letters = list("abcdefghij")
    for _ in range(60):
        words = ["".join(rng.choice(letters, rng.choice([2, 5, 9, 70]))) for _ in range(rng.integers(1, 30))]
        w = W.words_of(pa.array([" ".join(words)]))
        bins = lg.grams(w)
        score = [[sum(float(logs[bins[i], k]) for i in range(a, b)) for k in range(4)] for a, b in zip(w.starts, w.ends, strict=True)]
        like = [[max(math.exp(x - max(row)), lg.LEAST) for x in row] for row in score]
        assert set(np.flatnonzero(lg.inferred(w, logs)[1][0]).tolist()) == plain_set(like, lg.ROUNDS)


def test_one_unlikely_word_costs_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    names, logs = lg.learned(docs)
    by = {lang: docs.filter(docs.lang == lang).filter("length(text) between 500 and 900").first().text for lang in ("en", "de", "fr")}
    long_word = "".join(c for c in by["fr"] if c.isalpha())[:60]
    mixed = spark.createDataFrame([(1, f"{by['de']} {by['en']} {long_word}")], "doc_id long, text string")
    row = lg.identify(mixed, names, logs, ["doc_id"]).collect()[0]
    assert {"de", "en"} <= set(row._languages) and not any(math.isnan(x) for x in row._shares)


def test_two_languages_in_one_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    names, logs = lg.learned(docs)
    by = {lang: docs.filter(docs.lang == lang).filter("length(text) between 500 and 900").first().text for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, by["en"] + " " + by["de"]), (2, by["en"])], "doc_id long, text string")
    got = {r.doc_id: r._languages for r in lg.identify(mixed, names, logs, ["doc_id"]).collect()}
    assert set(got[1]) == {"en", "de"} and got[2] == ["en"]


def test_odd_documents(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 !? 4", "en", "s", 8), (4, "the and of the", "en", "s", 3), (4, "the and of the", "en", "s", 3),
           (None, "le la les des", "fr", None, None), (5, "日本語", None, None, None), (6, "the " * 50_000, None, "s", 0)]
    df = spark.createDataFrame(odd, SCHEMA).withColumnRenamed("source", "_x")
    rows = lg.identify(df, *lg.learned(lg.learn_from(df)), ["doc_id"]).collect()
    got = [(r.doc_id, r._lang) for r in rows]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and (5, "und") not in got
    assert got[3] == got[4] == (4, "en") and got[7] == (6, "en")
    kept = lg.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 5


def test_nothing_learned_or_nothing_there(spark):
    df = spark.createDataFrame([(1, "some words", None, None, None)], SCHEMA)
    assert [r._lang for r in lg.identify(df, *lg.learned(lg.learn_from(df)), ["doc_id"]).collect()] == ["und"]
    empty = df.limit(0)
    assert lg.identify(empty, *lg.learned(lg.learn_from(empty)), ["doc_id"]).collect() == []
