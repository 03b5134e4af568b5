"""Neighbours, forms and counts against all pairs of words; odd texts; hot nodes; long words."""

import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import spelling as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, depth int"


def plain_counts(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                count[word] += 1
    return count


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows):
    n = {w: c for w, c in plain_counts(rows).items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1, "w", 1) for i, t in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in sp.variants(df).collect())


def texts(words, rng, n, size):
    return [(rng.randint(0, 10**6), " ".join(rng.choice(words) for _ in range(size))) for _ in range(n)]


@pytest.mark.parametrize("salt_words", [3, 4096])
def test_dense_words(spark, monkeypatch, salt_words):
    monkeypatch.setattr(sp, "SALT_WORDS", salt_words)
    monkeypatch.setattr(sp, "HELD_WORDS", 50)
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀß") for _ in range(rng.randint(6, 9))) for _ in range(250)]
    rows = texts(words, rng, 40, 60)
    assert made(spark, rows) == plain(rows)


def test_shared_beginnings_and_ends(spark):
    rng = random.Random(8)
    stems = ["internation", "aaaaaaaa", "ßéßéßéßé"]
    words = [s + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for s in stems for _ in range(25)] + ["".join(rng.choice("xy") for _ in range(3)) + s for s in stems for _ in range(8)]
    rows = texts(words, rng, 30, 50)
    assert made(spark, rows) == plain(rows)


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji"]
    rows = [(i, " ".join([w] * 2)) for k, w in enumerate(chain) for i in range(12**k)]
    got = {r[0]: r for r in made(spark, rows)}
    assert sorted(got.values()) == plain(rows)
    assert got["abcdefgh"][2] == "abcdekji" and got["abcdekji"][1] is None


def test_odd_texts(spark):
    long_word = "".join(random.Random(1).choice("abcdefg") for _ in range(3000))
    rows = [(None, None), (1, ""), (2, "ABCDEFG abcdefg ABCDEFg"), (None, "abcdefg"), (3, "×÷×÷×÷× ×÷×÷×÷× ×÷×÷×÷÷"), (4, "日本abcdefh日abcdefhĀabcdefh"), (5, "abc1defgh"),
            (6, f"{long_word} {long_word[:-1]}"), (7, f"{long_word} {long_word[:-1]}"), (8, f"{long_word[:1500]}z{long_word[1500:]} " * 3), (9, "ábcdefgh " * 3), (10, "tiedaaaa tiedaaaa tiedaaab tiedaaab tiedaaac " * 2)]
    rows += [(20, "samesame samesamf")] * 50
    assert made(spark, rows) == plain(rows)


def test_no_words(spark):
    assert made(spark, [(1, "short words only"), (2, None)]) == []
    assert sp.variants(spark.createDataFrame([], SCHEMA)).collect() == []
