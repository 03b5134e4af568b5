"""The FM-index against plain search, and odd documents and items."""

import hashlib
import random
import re

import numpy as np

from parley.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for trial in range(30):
        parts = [rng.integers(1, 2 + trial % 5, rng.integers(1, 60)) for _ in range(8)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = dc.FMIndex(text)
        patterns = np.zeros((40, 6), np.int64)
        for row in patterns:
            n = rng.integers(1, 7)
            row[6 - n :] = rng.integers(1, 8, n)
        low, high = index.find(patterns)
        for row, a, b in zip(patterns, low, high, strict=True):
            p = row[row > 0]
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(13, len(v))
        for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v and name is not None else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def case():
    rng = random.Random(1)
    items = [(10, ITEM), (9, "short item"), (9, "short item"), (2, None), (3, ""), (4, "..."), (None, "no id at all"), (5, "a a a a a a a a a a a a a a a"), (7, "three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen")]
    docs = [None, "", "!!", ITEM, ITEM.upper() + " x " * 300, "this SHORT\nitem here", "no id at all", "a " * 40, "one two three", "é " * 50 + ITEM + " fifteen sixteen", " ".join(rng.choices("one two three four five short item a".split(), k=3000)), "x " * 60_000 + "short item"]
    return items, docs


def test_equals_a_plain_search(spark, monkeypatch):
    items, docs = case()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(docs)] + [(3, docs[3], None, None, None), (None, docs[5], None, None, None)], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars, shard in ((dc.PASS_CHARS, dc.SHARD_SYMBOLS), (20, 50)):
        monkeypatch.setattr(dc, "SHARD_SYMBOLS", shard)
        passes = dc.benchmark_passes(bench, chars=chars)
        assert (len(passes) > 5) == (chars == 20)
        for r in dc.find_passages(df, passes, ["doc_id"], clean=True).collect():
            text = docs[5 if r.doc_id is None else r.doc_id]
            n, hit, n_items, digest, _ = plain(text, items)
            assert (r._words, r._hit, len(r._items), hashlib.sha256(",".join(r._items).encode()).hexdigest()) == (n, hit, n_items, digest)
            if not hit:
                assert r._clean == (text if text is not None else None)
            else:
                assert len(words(r._clean)) == n - hit


def test_clean_documents_stay_and_lose_only_windows(spark):
    docs = [(1, ITEM, "en", "s", 1), (2, "start " + "word " * 500 + ITEM + " end", "en", "s", 1), (3, "nothing of it", None, None, None), (4, None, None, None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("source", "_hit")
    out = dc.decontaminate(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(2, "start " + "word " * 500 + " end"), (3, "nothing of it")] and out.count() == 4


def test_no_items_or_no_documents(spark):
    df = spark.createDataFrame([(1, "some words", None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.text for r in dc.decontaminate(df, none).collect()] == ["some words"]
    assert dc.decontaminate(df.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() == []


def test_chunks_hold_every_window(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(["Ab", "é", "x-y", "日本"]) + str(rng.randrange(50)) for _ in range(n))) for k, n in enumerate([0, 1, 5, 12, 13, 14, 29, 30, 31, 200])]
    df = spark.createDataFrame([*items, (None, "no id"), (77, None)], "item_id long, text string")
    got, largest = {}, 0
    for r in dc.item_chunks(df, words=10).collect():
        v = words(r.text)
        largest = max(largest, len(v))
        n = min(13, len(v))
        got.setdefault(int(r.name), []).extend(tuple(v[i : i + n]) for i in range(len(v) - n + 1))
    for k, text in items:
        v = words(text)
        n = min(13, len(v))
        assert sorted(set(got.get(k, []))) == sorted({tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set())
    assert largest == 22


def test_the_query_in_many_passes(spark, monkeypatch):
    """The whole query on the table, with passes of a few items each, gives the same rows."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, dc.op9_fm_index_decontamination(spark, sf).collect()))
    size = sum(len(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text)
    monkeypatch.setattr(dc.benchmark_passes, "__defaults__", (dc.WINDOW, size // 4))
    assert sorted(map(tuple, dc.op9_fm_index_decontamination(spark, sf).collect())) == whole
