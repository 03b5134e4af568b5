"""Frame features, two-means, edit distances and ranges of names against plain versions."""

import cmath
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from parley.functions import hops, stitching
from parley.functions.names import prefer_longer_names
from parley.operators import features, metrics, relabel as rl
from parley.plans.slabs import in_ranges
from parley.sources import adapters


def plain_features(x, rate, threshold):
    frame, hop = rate * features.FRAME_MS // 1000, rate * features.HOP_MS // 1000
    taper = [0.5 - 0.5 * math.cos(2 * math.pi * i / (frame - 1)) for i in range(frame)]
    out = {}
    for at in range(0, len(x) - frame + 1, hop):
        w = x[at : at + frame]
        rms = math.sqrt(sum(v * v for v in w) / frame + 1e-12)
        if rms < threshold:
            continue
        power = [abs(sum(v * t * cmath.exp(-2j * math.pi * k * i / frame) for i, (v, t) in enumerate(zip(w, taper)))) for k in range(frame // 2 + 1)]
        centre = sum(p * k * rate / frame for k, p in enumerate(power)) / (sum(power) + 1e-12) / 1000
        sign = [(v > 0) - (v < 0) for v in w]
        out[at] = (math.log1p(rms * 100), centre, sum(abs(b - a) for a, b in zip(sign, sign[1:])) / (frame - 1) / 2)
    return out


@pytest.mark.parametrize("slab", [3, 1000])
def test_frame_features(spark, slab):
    rnd = random.Random(1)
    series = {"m": [math.sin(i / 3) * (i % 200 > 60) + rnd.gauss(0, 0.02) for i in range(400)], "short": [0.5] * 5, "quiet": [0.001] * 120}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "meeting_id string, frame_idx long, x double")
    got = {}
    for r in features.frame_features(df, ["meeting_id"], 1000, 0.05, slab).collect():
        got.setdefault(r.meeting_id, {})[r.pos] = (r.loudness, r.centroid, r.zcr)
    want = {k: f for k, x in series.items() if (f := plain_features(x, 1000, 0.05))}
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    assert all(got[k][at] == pytest.approx(f, abs=1e-9) for k, own in want.items() for at, f in own.items())


def plain_two_means(v, rounds):
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    c = [v[0], max(enumerate(v), key=lambda p: (far(p[1], v[0]), -p[0]))[1]]
    for _ in range(rounds):
        side = [int(far(x, c[1]) < far(x, c[0])) for x in v]
        new = [[sum(x[i] for x, s in zip(v, side) if s == k) / side.count(k) for i in range(len(v[0]))] if k in side else c[k] for k in (0, 1)]
        if new == c:
            break
        c = new
    side = [int(far(x, c[1]) < far(x, c[0])) for x in v]
    spread = sum(far(x, c[s]) for x, s in zip(v, side)) / len(v)
    return len(v), sum(side), math.sqrt(far(*c)), spread


def test_two_means(spark):
    rnd = random.Random(9)
    meetings = {k: [[rnd.gauss(c * gap, 0.3) for c in (i % 3 == 0, 1, 0)] for i in range(n)] for k, n, gap in (("a", 240, 4), ("b", 60, 0), ("c", 1, 1), ("d", 7, 9))}
    rows = [(k, i, x) for k, v in meetings.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "meeting_id string, pos long, v array<double>")
    got = {r.meeting_id: r for r in rl.count_speakers(df, 3).collect()}
    for k, v in meetings.items():
        n, n1, gap, spread = plain_two_means(v, rl.ROUNDS)
        r = got[k]
        assert (r.n, r.n1) == (n, n1) and (r.gap, r.spread) == pytest.approx((gap, spread), abs=1e-6)
        least = min(n1, n - n1)
        two = n >= rl.MIN_FRAMES and least >= max(rl.MIN_MEMBERS, math.floor(n * rl.MIN_SHARE)) and gap >= rl.MIN_GAP and gap >= max(spread, rl.MIN_SPREAD) * rl.GAP_TO_SPREAD
        assert r.n_speakers == 1 + two
    assert {r.n_speakers for r in got.values()} == {1, 2}


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("block", [1, 3, 7, 64, 4096])
def test_edit_distance_in_blocks(block):
    rnd = random.Random(block)
    for _ in range(300):
        a, b = (rnd.choices("abcd", k=rnd.randrange(0, 25)) for _ in range(2))
        if rnd.random() < 0.5:
            b = [x for x in a if rnd.random() > 0.2] + b[:2]
        assert metrics.edit_distance(a, b, block) == table_distance(a, b)


def test_a_long_recording():
    rnd = random.Random(5)
    a = [f"w{rnd.randrange(5000)}" for _ in range(100_000)]
    b = list(a)
    for _ in range(3000):
        b[rnd.randrange(len(b))] = "changed"
    began = time.time()
    got = metrics.edit_distance(a, b)
    assert sum(x != y for x, y in zip(a, b)) - 5 <= got <= sum(x != y for x, y in zip(a, b))
    assert time.time() - began < 60


def test_ranges_of_names_are_even(spark):
    rows = [("m", f"common beginning {i:05d}") for i in range(4000)] + [("n", "other"), ("n", "others"), (None, "x")]
    df = spark.createDataFrame(rows, "k string, name string")
    sizes = [r["count"] for r in in_ranges(df, ["k", "name"]).groupBy("_slab").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    kept = prefer_longer_names(df.withColumn("o", F.lit(1)), "k", "name", "o")
    assert kept.where("k = 'n'").collect()[0].name == "others" and kept.where("k = 'm'").count() == 4000


def test_stitched_columns_equal_the_fold_of_two_texts(spark):
    """On the pairs of all utterances, and on hand-made ones, the columns give what a fold over two rows gives."""
    sf = "/root/testdata/sf0.001"
    rnd = random.Random(8)
    words = "we will meet at noon in the hall plan budget team music [music] 12 ok ok".split()
    pairs = [(r.a, r.b) for r in adapters.text_pairs(spark, sf).collect()]
    pairs += [("we will meet at noon", "at noon in the hall"), ("a good clear sentence here", "Music"), ("", "x y"), ("hello there", "hello there friend"), ("a", ""), (None, "b"), ("no no no no no no", "a clear answer to it")]
    pairs += [(" ".join(rnd.choices(words, k=rnd.randrange(0, 12))), " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for _ in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string").repartition(8)
    got = {r.i: r.stitched for r in stitching.with_stitched(df, "a", "b", "stitched").collect()}
    assert {i: s for i, s in got.items() if s != hops.stitch(pairs[i][0] or "", pairs[i][1] or "")} == {}
