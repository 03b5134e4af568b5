"""Digests against a plain count, neighbours across partitions, odd and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, n_chars long, part int"


def plain_codes(text):
    data = text.encode()
    count = Counter(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 23 for i in range(len(data) - 2))
    counts = [count[b] for b in range(fp.BUCKETS)]
    ordered = sorted(counts)
    return [sum(c > ordered[k * fp.BUCKETS // 4 - 1] for k in (1, 2, 3)) for c in counts]


def plain_size(text):
    n = len(text.encode()) + 1
    power = n.bit_length() - 1
    return 4 * power + ((n << 2) >> power) % 4


def plain_near(a, b):
    x, y = plain_codes(a), plain_codes(b)
    steps = sum(abs(i - j) for i, j in zip(x, y, strict=True)) + min(abs(plain_size(a) - plain_size(b)), 16)
    bound = min(640, sum(x) + sum(y)) + 16
    return 1 - min(steps, bound) / bound


def plain(rows):
    """doc_id: result, for distinct doc_ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        x = text[: n - n // 3] + after[: n // 3]
        out[doc_id] = (n, hashlib.sha256(x.encode()).hexdigest(), plain_near(text, x), plain_near(text, after))
    return out


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéfü日") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 300]))) for _ in range(n)]


def test_digests_are_the_plain_ones():
    column = ["", "a", "ab", "abc", None, "aaaa" * 500, *texts(30), "é" * 5]
    got = fp.Digests(pa.array(column, pa.string()))
    assert got.codes.tolist() == [plain_codes(t or "") for t in column] and got.sizes.tolist() == [plain_size(t or "") for t in column]
    back = fp.Digests.read(got.texts())
    assert (back.codes == got.codes).all() and (back.sizes == got.sizes).all()


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_pieces_of_long_texts_make_no_difference(monkeypatch, step):
    raw, offsets = fp.text_bytes(pa.array(texts(4)))
    want = fp.bucket_counts(raw, offsets)
    monkeypatch.setattr(fp, "POSITIONS", step)
    assert (fp.bucket_counts(raw, offsets) == want).all()


@pytest.mark.parametrize("part_bytes", [40_000, 1 << 30])
def test_neighbours_across_partitions(spark, part_bytes):
    rows = [(3 * i - 20, t) for i, t in enumerate(texts(60))] + [(1000, None), (-500, ""), (2000, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, "old", -1, 9) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fp.edited(df, part_bytes).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.n_chars, r.edited_sha256) == want[i][:2]
        assert r.near_edited == pytest.approx(want[i][2], abs=1e-12) and r.near_next == pytest.approx(want[i][3], abs=1e-12)


def test_repeated_and_missing_ids(spark):
    rows = [(7, "one text here")] * 400 + [(None, "no id"), (None, None), (8, "eight eight")]
    got = fp.edited(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(6), 500).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    sevens = [r for r in got if r.doc_id == 7]
    assert len({r.fingerprint for r in sevens}) == 1 and sum(r.near_next == 1 for r in sevens) == 399


def test_lone_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef", "", 0, 0)], SCHEMA)
    r = fp.edited(one).collect()[0]
    assert (r.n_chars, r.edited_sha256, r.near_next) == (6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)
    assert fp.edited(one.limit(0)).collect() == [] and fp.fingerprints(one.limit(0)).collect() == []


def test_likeness_of_stored_fingerprints(spark):
    column = texts(12) + [None, "", "abc"]
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(column)], SCHEMA)
    own = fp.fingerprints(df)
    met = own.crossJoin(own.toDF("other", "second"))
    for r in met.select("doc_id", "other", fp.digest_likeness("fingerprint", "second").alias("near")).collect():
        assert r.near == pytest.approx(plain_near(column[r.doc_id] or "", column[r.other] or ""), abs=1e-12)


def test_edits_stay_near_on_the_table(spark):
    got = fp.op12_quartile_fingerprint(spark, "/root/testdata/sf0.01").toPandas()
    different = got[got.near_next < 1]
    assert np.mean(different.near_edited > different.near_next) > 0.99
