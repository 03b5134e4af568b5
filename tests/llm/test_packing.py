"""Packing against a plain reading of its contract."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parley.llm import packing as pk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check_pieces(rows, docs, window):
    """Every id in one piece, checksums right, sequences gapless and at most the window; returns sequence lengths."""
    tokenizer = Tokenizer.from_file(pk.tokenizer_path())
    want = defaultdict(list)
    for d in docs:
        want[d[0]].append(tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, texts in want.items():
        ids = texts[0]
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                at += r.length
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    return [sum(r.length for r in own) for own in by_sequence.values()]


def test_pieces_of_odd_documents(spark):
    rng = random.Random(5)
    words = ["Ärger", "the", "don't", "x9.y", "<|endoftext|>", "a.,b", "...", "naïve", "é.", "日本語", " z", "it's", "#1,000.5"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 50, 400, 3000]))), "en", None, 1) for i in range(80)]
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "\n \t", "en", "s", 0), (103, "same", "en", "s", 0), (103, "same", "en", "s", 0), (None, "no id", None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    sizes = check_pieces(pk.pack(df, window=512).collect(), docs, 512)
    assert all(n == 512 or n & (n - 1) == 0 for n in sizes)


def test_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(pk.tokenizer_path())
    texts = ["Hello, world.It's 3.5", " a b.́c ", "don't.stop,now...", "ÀÉ. é, É", "", None, "x" * 500 + ".", "a,b,,c.'s '", "I'LL.'ve"]
    ids, offsets = pk.token_ids(pa.array(texts), pk.tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def test_no_documents(spark):
    assert pk.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeats_are_least_squares():
    histogram = np.zeros(64, np.int64)
    histogram[[16, 24, 40, 48]] = [100, 30, 30, 100]
    patterns = pk.combinations(histogram, 64)
    x = pk.repeats(patterns, histogram.astype(float), 2000)
    fit = np.zeros(64)
    for p, n in zip(patterns, x, strict=True):
        for a, k in p.items():
            fit[a] += k * n
    assert (x >= 0).all() and np.abs(fit - histogram).max() < 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_covers_every_tail_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(256, np.int64)
    for a in rng.integers(1, 256, 2000):
        histogram[a] += 1
    plan = pk.Plan(histogram, 256)
    length = np.repeat(np.arange(256), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram])
    who, start, size, sequence, offset = map(np.array, plan.pieces(length, rank))
    assert np.array_equal(np.bincount(who, size), length)
    filled = np.bincount(sequence, size).astype(int)
    assert filled.max() <= 256 and sum(n < 256 for n in filled) <= 8
    assert all(n == 256 or n & (n - 1) == 0 for n in filled)


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(pk.op10_least_squares_packing(spark, sf).collect(), docs, 4096)
