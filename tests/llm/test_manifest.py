"""Roots, proofs and checks against a plain tree; odd rows; deep trees."""

import hashlib
import random
import zlib

import pytest

from parley.llm import manifest as mf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def runs(levels, at, fan):
    for level in levels[:-1]:
        first = at - at % fan
        yield level[first:at], level[at + 1 : first + fan]
        at //= fan


def plain(rows, fan=16):
    order = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf(r) for r in order if r[3] == s], fan) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources], fan)
    out = []
    for s in sources:
        for i, r in enumerate([r for r in order if r[3] == s]):
            steps = [*runs(trees[s], i, fan), *runs(top, sources.index(s), fan)]
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in steps:
                node = sha(*left, node, *right)
            proof = sha(*[x for left, right in steps for x in [*left, *right]])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(5)


def made(spark, rows):
    return sorted((tuple(r) for r in mf.manifest(frame(spark, rows)).collect()), key=str)


def corpus(sizes, seed=2):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = "".join(rng.choice("abcABCéÉ日 ") for _ in range(rng.randint(0, 30)))
            rows.append((rng.randint(-1000, 10**12), text, rng.choice(["en", None]), source, len(text)))
    return rows


def test_trees_of_all_shapes(spark):
    rows = corpus({None: 3, "": 1, "one": 1, "ü": 16, "z": 17, "日": 33, "hot": 600, **{f"s{i}": 1 for i in range(20)}})
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("step", [1, 2, 3])
def test_deep_trees(spark, monkeypatch, step):
    monkeypatch.setattr(mf, "BITS", 1)
    monkeypatch.setattr(mf, "FAN", 2)
    monkeypatch.setattr(mf, "STEP", step)
    rows = corpus({"a": 37, "b": 8, "c": 1, "d": 9, "e": 2}, seed=4)
    assert made(spark, rows) == plain(rows, 2)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "A B", "en", "s", 3)] * 40 + [(5, None, "en", "s", 3), (7, "Q" * 2_000_000, "de", "s", 0), (None, "", "", "", 0)]
    assert made(spark, rows) == plain(rows)


def test_lone_row_and_none(spark):
    row = (10, "abc", "en", "s", 3)
    got = made(spark, [row])
    assert got == plain([row]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha()
    assert mf.manifest(frame(spark, [row]).limit(0)).collect() == []
