"""Multi-index hashing: pigeonhole probing is complete, recall, odd vectors."""

import numpy as np
import pytest

from parley.llm import neighbours as nb


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    block = rng.integers(0, 256, (2000, nb.PARTS)).astype(np.uint8)
    index = nb.Index(block)
    for radius in (0, 3, 15, 16, 17, 40, 50, 60, 70):
        code = block[radius] ^ (rng.random(nb.PARTS) < 0.2).astype(np.uint8)
        differ = np.unpackbits(block ^ code, axis=1).sum(1)
        assert index.within(code, radius).tolist() == np.flatnonzero(differ <= radius).tolist()


def brute(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            score = (x * q).sum(1)
            order = [j for j in np.lexsort([ids, -score]) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in nb.op5_multi_index_hashing(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all([x[0] for x in g] == list(range(1, 21)) for g in got.values())
    hits = sum(len({x[0] for x in want[q]} & {x[1] for x in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = dict(rows)
    assert all(s == pytest.approx(float(np.dot(np.array(exact[q], float), np.array(exact[v], float))), abs=1e-12) for q in list(got)[:5] for _, v, s in got[q])


def test_lengths_matter_and_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(nb, "INDEX_ROWS", 100)
    monkeypatch.setattr(nb, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.1, 9, (700, 1))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1])]
    want = brute(rows)
    got = {}
    for r in nb.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len({v for v, _ in want[q]} & set(got[q])) for q in want)
    assert set(got) == set(want) and hits / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [2.0, 1.0]), (21, [2.0, 1.0])]
    odd = [(40, None), (2, [0.0, 0.0]), (3, [1.0, None]), (60, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nb.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4.0), (0, 2, 20, 4.0), (0, 3, 21, 4.0), (20, 1, 1, 5.0), (20, 2, 21, 5.0), (20, 3, 0, 4.0)]
    assert nb.nearest(df.limit(0)).collect() == [] and nb.nearest(df.filter("vec_id = 2")).collect() == []
