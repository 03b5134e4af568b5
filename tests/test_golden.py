"""Small cases with known results, and the folds against a plain sequential run."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import hooks, hops, quality, text as tx
from parley.operators import frames as fr, intervals as iv, metrics, minutes as mn, packing as pk, reconcile as rc, relabel as rl, tables as tb
from parley.plans.carry import carry_fold
from parley.streaming import live

TURN = "meeting_id string, speaker_id string, start_ms long, end_ms long, is_overlap boolean, interval_id long"


def turns(spark, *rows):
    return spark.createDataFrame([("m", s, a, b, False, i) for i, (s, a, b) in enumerate(rows)], TURN)


def windows(spark, *rows):
    schema = T.StructType(
        [T.StructField("meeting_id", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()),
         T.StructField("text", T.StringType()), T.StructField("words", rc.WORDS), T.StructField("window_id", T.LongType())]
    )
    return spark.createDataFrame([("m", a, b, t, w, i) for i, (a, b, t, w) in enumerate(rows)], schema)


def segs(spark, *rows):
    schema = T.StructType([T.StructField("meeting_id", T.StringType()), *rc.SEGMENT.fields])
    return spark.createDataFrame([("m", a, b, s, t, False, p, []) for a, b, s, t, p in rows], schema)


def result(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- intervals ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "rows, flags",
    [
        ([("A", 0, 5000), ("B", 1000, 6000)], [True, True]),
        ([("A", 0, 4000), ("B", 4000, 8000)], [False, False]),
        ([("A", 0, 4000), ("A", 1000, 2000)], [False, False]),
        ([("A", 0, 2_000_000), ("B", 600_000, 600_001), ("C", 1_200_000, 1_200_000)], [True, True, False]),
    ],
)
def test_mark_overlaps(spark, rows, flags):
    got = iv.mark_overlaps(turns(spark, *rows), ["meeting_id"])
    assert [f for _, f in result(got, "interval_id", "is_overlap")] == flags


def test_regions_around_a_bin_edge(spark):
    """An end on a bin edge while somebody else goes on."""
    t = turns(spark, ("A", 0, 600_000), ("B", 10, 600_100))
    assert result(iv.atomic_regions(t, ["meeting_id"]), "region_start", "region_end", "n_speakers") == [
        (0, 10, 1), (10, 600_000, 2), (600_000, 600_100, 1)]


def test_a_point_meets_each_speaker_once(spark):
    """However many turns of a speaker cover a point, one span leads there: the first turn still heard."""
    rnd = random.Random(9)
    rows = [("m", rnd.choice(["a", "b", None]), s, s + rnd.randrange(-5, 900_000), i // 2) for i in range(300) for s in [rnd.randrange(0, 50) * 40_000]]
    rows += [(None, "a", 0, 10, 900), ("m", "a", None, 10, 901), ("m", "a", 5, None, 902)]
    turns = spark.createDataFrame(rows, "meeting_id string, speaker_id string, start_ms int, end_ms int, interval_id long")
    points = spark.createDataFrame([("m", t) for t in [*range(0, 2_900_000, 70_000), 40_000, 40_000]], "meeting_id string, t long")
    first, at = {}, {r.t for r in points.collect()}
    for m, who, s, e, n in rows:
        for t in at if m and None not in (s, e) else ():
            if s <= t < e:
                first[t, who] = min(first.get((t, who), (s, e, n)), (s, e, n))
    got = {(r.t, r.speaker_id): (r.ord.start_ms, r.ord.end_ms, r.ord.interval_id) for r in iv.speakers_at(points, turns, "t", ["meeting_id"]).collect()}
    assert got == first
    assert iv.heard_at(points.distinct(), turns, "t", ["meeting_id"]).count() == len(first)


def test_flicker_is_no_overlap(spark):
    t = turns(spark, ("A", 0, 3040), ("B", 3000, 6040), ("A", 6000, 8000))
    w = windows(spark, (0, 8000, "all", []))
    assert iv.significant_overlap(w, iv.shared_regions(t), ["meeting_id", "window_id"]).count() == 0


def test_merge_turns(spark):
    t = turns(spark, ("a", 0, 1000), ("a", 1100, 2000), ("b", 500, 1500))
    assert result(iv.merge_speaker_turns(t, ["meeting_id"]), "speaker_id", "start_ms", "end_ms") == [("a", 0, 2000), ("b", 500, 1500)]


def test_overlap_join_gives_each_pair_once(spark):
    rnd = random.Random(1)
    a = [("x", s, s + rnd.randrange(0, 900)) for s in (rnd.randrange(0, 3000) for _ in range(60))]
    b = [("y", s, s + rnd.randrange(0, 900)) for s in (rnd.randrange(0, 3000) for _ in range(60))]
    left = turns(spark, *a).select("meeting_id", F.col("interval_id").alias("l"), F.col("start_ms").alias("l0"), F.col("end_ms").alias("l1"))
    got = iv.overlap_join(left, turns(spark, *b), ["meeting_id"], ("l0", "l1"), ("start_ms", "end_ms"), bin_ms=100)
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b)
                  if min(x[2], y[2]) > max(x[1], y[1]))
    assert result(got, "l", "interval_id", "overlap_ms") == want


def test_relabel_by_time_keeps_names(spark):
    old = turns(spark, ("SPEAKER_00", 0, 5000), ("SPEAKER_01", 5000, 9000))
    new = turns(spark, ("SPEAKER_01", 0, 4900), ("SPEAKER_00", 5100, 9000))
    assert result(rl.relabel_by_time(new, old), "start_ms", "speaker_id") == [(0, "SPEAKER_00"), (5100, "SPEAKER_01")]


# ---- samples -----------------------------------------------------------------------------


def samples(spark, n, x=0.1):
    return spark.range(n).select(F.lit("m").alias("meeting_id"), F.col("id").alias("frame_idx"), F.lit(x).alias("x"))


def test_hopping_windows_and_tail(spark):
    hop = dict(frame_ms=100, window_ms=8000, hop_ms=6000, min_rms=0.05)
    assert [s for s, in result(fr.hopping_windows(samples(spark, 200), ["meeting_id"], **hop), "start_ms")] == [0, 6000, 12000]
    ten = samples(spark, 100)
    assert result(fr.hopping_windows(ten, ["meeting_id"], **hop), "start_ms") == [(0,)]
    assert result(fr.tail_window(ten, ["meeting_id"], **hop), "start_ms", "end_ms") == [(6000, 10000)]
    quiet = samples(spark, 200, 0.001)
    assert fr.hopping_windows(quiet, ["meeting_id"], **hop).count() == fr.tail_window(quiet, ["meeting_id"], **hop).count() == 0


def test_smoothing_across_slabs(spark):
    f = samples(spark, 40).withColumn("label", F.when(F.col("frame_idx") % 7 == 3, "b").otherwise("a"))
    assert result(fr.smooth_labels(f, ["meeting_id"], "label", width=4), "smoothed") == [("a",)] * 40


# ---- text ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, language, reason",
    [
        ("very " * 40, "en", "word_run"),
        ("penavava a", "fa", "wrong_script"),
        ("Music", "en", "whisper_boilerplate"),
        ("[Music]", "en", "whisper_boilerplate"),
        ("♪ music ♪", "en", "whisper_boilerplate"),
        ("Subtitles", "en", "whisper_boilerplate"),
    ],
)
def test_gate_drops(spark, text, language, reason):
    row = quality.with_gate(spark.createDataFrame([(text,)], "text string"), "text", language).first()
    assert row["action"] == "drop" and row["score"] < 0.35
    assert any(reason in r for r in row["reasons"])


def test_gate_fixes_and_keeps(spark):
    df = spark.createDataFrame([("a plain sentence about plans",), ("(Coughs) hello there friends",), ("no no no we will not go",)], "text string")
    got = [(r["action"], r["gated_text"]) for r in quality.with_gate(df, "text").orderBy("text").collect()]
    assert sorted(got) == [("fix", "(cough) hello there friends"), ("fix", "no we will not go"), ("keep", "a plain sentence about plans")]


REPEATS = [
    ("one two three one two three", "one two three"),
    ("we go home we go home now then", "we go home now then"),
    ("First point. First point. Second point.", "First point. Second point."),
    ("a b a b a b a b c", "a b c"),
    ("no repeats in this text", "no repeats in this text"),
    ("spaced   out\ntext", "spaced out text"),
]


def test_collapse_repeats(spark):
    df = spark.createDataFrame(REPEATS, "text string, want string")
    for r in hops.collapse_repeats_column(df, "text", "got").collect():
        assert r["got"] == r["want"] == hops.collapse_repeats(r["text"])


def test_native_flag_covers_all_repeats(spark):
    """Texts the native test passes over are texts the row helper leaves alone."""
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice(["ab", "a", "abc", "b.", "ab!"]) for _ in range(rnd.randrange(1, 14))),) for _ in range(400)]
    df = hops.collapse_repeats_column(spark.createDataFrame(rows, "text string"), "text", "got")
    for r in df.collect():
        assert r["got"] == hops.collapse_repeats(r["text"]), r["text"]


def test_phrases_said_twice_are_found_in_batches():
    import re

    import pyarrow as pa

    rnd = random.Random(6)
    lines = [" ".join(rnd.choice(["ab", "a", "b.", "و"]) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)]
    lines += [" ".join(map(str, [*range(k), *range(k)])) for k in range(1, 11)] + ["a b c", "a b c"]
    phrase = re.compile(r"(?<!\S)(\S++(?: \S++){1,7}) \1(?!\S)")
    assert hops.said_twice(pa.array(lines)).to_pylist() == [bool(phrase.search(line)) for line in lines]
    assert hops.said_twice(pa.array(lines[:1])).to_pylist() == [bool(phrase.search(lines[0]))]
    assert hops.said_twice(pa.array([], pa.string())).to_pylist() == []


def test_repeats_are_found_without_a_pattern_over_whole_texts(spark):
    """The patterns that look for a phrase from every word on stay out of the plan."""
    df = spark.createDataFrame([("a b",)], "text string").select(F.concat("text", F.lit(" c")).alias("text"))
    plan = hops.collapse_repeats_column(df, "text", "got")._jdf.queryExecution().optimizedPlan().toString()
    assert "{1,7}" not in plan


def test_long_texts_of_noise_are_stock_phrases_still(spark):
    rows = [("_ " * 200 + "music", True), ("m\u200cu" + "\u200d" * 300 + "sic", True), ("music " * 60, False), ("thank you for watching" + " ." * 200, True), ("thank you for watching all", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("k", tx.tokens(F.col("t")))
    for r in tx.with_boilerplate(df, "t", "k", "got").collect():
        assert r.got == r.want, r.t


def test_helper_quality_equals_columns(spark):
    rnd = random.Random(7)
    vocabulary = ["so", "yes", "we", "(music)", "plan", "و", "...", "10", "blank_audio", "thank", "you"]
    rows = [(" ".join(rnd.choice(vocabulary[: rnd.randrange(1, 11)]) for _ in range(rnd.randrange(0, 20))),) for _ in range(400)]
    for r in quality.with_score(spark.createDataFrame(rows, "text string"), "text").collect():
        want = 0.0 if r["score"] == 0.05 else r["score"]
        assert abs(hops.quality(r["text"]) - want) < 1e-9, r["text"]


def test_stitch():
    assert hops.stitch("we will meet at noon", "at noon in the hall") == "we will meet at noon in the hall"
    assert hops.stitch("a good clear sentence here", "Music") == "a good clear sentence here"
    assert hops.stitch("", "x y") == "x y"
    assert hops.stitch("hello there", "hello there friend") == "hello there friend"


def test_faithful(spark):
    long = "we agreed that the new plan starts on monday morning and everyone joins the call"
    df = spark.createDataFrame([(long, long), (long, long.replace("monday", "Monday,")), (long, "they made a plan")], "a string, b string")
    assert [r[0] for r in quality.with_faithful(df, "a", "b").select("faithful").collect()] == [True, True, False]


# ---- packing and metrics --------------------------------------------------------------------


def test_worst_items(spark):
    rows = [("m", "ok", 0.99, ["x"], 0), ("m", "bad", 0.5, [], 1), ("m", "so so", 0.7, [], 2), ("m", "worst", 0.4, [], 3), ("m", " worst ", 0.4, [], 4)]
    df = spark.createDataFrame(rows, "k string, text string, score double, reasons array<string>, ord long")
    assert result(pk.worst_items(df, "k", "text", "ord", 2), "rank", "text") == [(1, "worst"), (2, "bad")]


def test_line_split_rejoins(spark):
    rnd = random.Random(3)
    texts = ["x" * rnd.randrange(0, 60) for _ in range(50)] + ["y" * 205]
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "k string, pos long, line string")
    rows = pk.split_lines(df, "k", "pos", "line", 80, slab_rows=7).orderBy("pos", "piece").collect()
    chunks = {}
    for r in rows:
        chunks.setdefault(r["chunk"], []).append(r["text"])
    parts = ["\n".join(c) for _, c in sorted(chunks.items())]
    assert max(map(len, parts)) <= 80 and sorted(chunks) == list(range(1, len(chunks) + 1))
    joined = {}
    for r in rows:
        joined[r["pos"]] = joined.get(r["pos"], "") + r["text"]
    assert [joined[i] for i in range(len(texts))] == texts
    # Greedy: no chunk could have taken the line that starts the next one.
    for a, b in zip(parts, parts[1:]):
        first = b.split("\n")[0]
        assert len(a) + 1 + len(first) > 80 or "y" in a + b


def test_batches_lose_nothing(spark):
    df = spark.createDataFrame([("m", i, "z" * 30) for i in range(10)], "k string, pos long, text string")
    rows = pk.batch_items(df, "k", "pos", "text", 200, slab_rows=3).collect()
    assert len(rows) == 10 and max(r["batch"] for r in rows) == 5


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_errors(spark):
    rnd = random.Random(2)
    rows = [("hello dear friends", "hello friends"), ("", ""), ("", "a"), ("é e", "e é")]
    rows += [(" ".join(rnd.choices("abcdé", k=rnd.randrange(1, 30))), " ".join(rnd.choices("abcdé", k=rnd.randrange(0, 30)))) for _ in range(50)]
    for r in metrics.with_word_errors(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect():
        n, edits = len(r["a"].split()), edit_distance(r["a"].split(), r["b"].split())
        assert r["n_edits"] == edits
        assert r["wer"] == (edits / n if n else float(bool(r["b"])))


def test_speaker_errors_against_frames(spark):
    rnd = random.Random(4)
    make = lambda: [(rnd.choice("AB"), s, s + rnd.randrange(0, 1500)) for s in (rnd.randrange(0, 5000) for _ in range(12))]
    ref, hyp = make(), make()
    got = metrics.speaker_error_rate(turns(spark, *ref), turns(spark, *hyp), ["meeting_id"], bin_ms=700).first()
    heard = lambda side, t: {s for s, a, b in side if a <= t < b}
    grid = [(heard(ref, t), heard(hyp, t)) for t in range(0, 7000, 100)]
    assert got["scored"] == sum(bool(r | h) for r, h in grid)
    assert got["errors"] == sum(r != h for r, h in grid)


# ---- windows to segments -------------------------------------------------------------------------


def test_hop_variants_become_one_row(spark):
    t = turns(spark, ("SPEAKER_00", 0, 20_000))
    text = "we should start the meeting now"
    w = windows(spark, (0, 8000, text, []), (2000, 10_000, text + " please", []), (4000, 12_000, text + " please", []), (6000, 14_000, ".", []))
    got = result(rc.align_windows(w, t, ["meeting_id"]), "speaker_id", "text", "is_overlap")
    assert got == [("SPEAKER_00", text + " please", False)]


def test_overlap_window_goes_to_both(spark):
    t = turns(spark, ("A", 0, 8000), ("B", 2000, 7000))
    got = result(rc.align_windows(windows(spark, (0, 8000, "both of us talk", [])), t, ["meeting_id"]), "speaker_id", "start_ms", "end_ms", "is_overlap")
    assert got == [("A", 2000, 7000, True), ("B", 2000, 7000, True)]


def test_timed_words_split_at_the_turn(spark):
    words = [("hello", 0, 1000), ("Alex", 1000, 2000), ("good", 4500, 5500), ("morning", 5500, 6500)]
    t = turns(spark, ("A", 0, 4000), ("B", 4000, 8000))
    got = result(rc.align_windows(windows(spark, (0, 8000, "hello Alex good morning", words)), t, ["meeting_id"]), "start_ms", "speaker_id", "text")
    assert got == [(0, "A", "hello Alex"), (4500, "B", "good morning")]


def test_few_timed_words_do_not_replace_the_text(spark):
    t = turns(spark, ("A", 0, 8000))
    w = windows(spark, (0, 8000, "one two three four five six", [("one", 0, 500)]))
    assert result(rc.align_windows(w, t, ["meeting_id"]), "text") == [("one two three four five six",)]


def test_absorb_short_turns(spark):
    t = turns(spark, ("A", 0, 1000), ("B", 1010, 1200), ("A", 1210, 2000), ("B", 2500, 4000))
    assert result(rc.absorb_short_turns(t, ["meeting_id"]), "start_ms", "speaker_id", "end_ms") == [(0, "A", 2000), (2500, "B", 4000)]


def random_segments(n):
    rnd = random.Random(11)
    vocabulary = "plan budget team week review launch design data next call agree point".split()
    at, rows = 0, []
    for _ in range(n):
        at += rnd.choice([0, 300, 900, 2500, 7000])
        rows.append((at, at + rnd.randrange(500, 6000), rnd.choice("AB"), " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 9))), rnd.random() < 0.3))
    return rows


@pytest.mark.parametrize("op", [rc.dedupe_segments, rc.merge_adjacent])
def test_slabs_do_not_change_a_fold(spark, op):
    rows = random_segments(70)
    cols = ["start_ms", "end_ms", "speaker_id", "text", "provisional"]
    whole = result(op(segs(spark, *rows), ["meeting_id"]), *cols)
    random.Random(1).shuffle(rows)
    assert result(op(segs(spark, *rows), ["meeting_id"], slab_rows=5), *cols) == whole
    assert len(whole) < 70


def test_dedupe_is_stable(spark):
    once = rc.dedupe_segments(segs(spark, *random_segments(40)), ["meeting_id"])
    cols = ["start_ms", "end_ms", "speaker_id", "text"]
    assert result(rc.dedupe_segments(rc.dedupe_segments(once, ["meeting_id"]), ["meeting_id"]), *cols) == result(
        rc.dedupe_segments(once, ["meeting_id"]), *cols)


def test_late_dissimilar_windows_survive(spark):
    t = turns(spark, ("A", 0, 80_000))
    w = windows(spark, (0, 8000, "the budget is fixed for this year", []), (6000, 14_000, "the budget is fixed for this year now", []),
                (60_000, 68_000, "lunch comes at noon from the corner shop", []), (66_000, 74_000, "lunch comes at noon from the corner shop today", []))
    text = " ".join(r[0] for r in result(rc.align_windows(w, t, ["meeting_id"]), "text"))
    assert "budget" in text and "lunch" in text


def test_carry_reaches_through_many_slabs(spark):
    """A running total that is handed from slab to slab."""
    def fold(carry, rows, end):
        total, out = carry or 0, []
        for i in rows["i"]:
            total += int(i)
            out.append((int(i), total))
        return out, total

    out = T.StructType([T.StructField("i", T.LongType()), T.StructField("total", T.LongType())])
    df = spark.range(23).select(F.lit("m").alias("k"), F.col("id").alias("i"))
    got = result(carry_fold(df, ["k"], ["i"], 100, fold, out, slab_rows=4), "i", "total")
    assert got == [(i, i * (i + 1) // 2) for i in range(23)]


# ---- tables and live ---------------------------------------------------------------------------------


def test_edits(spark):
    rows = [("m", "1", 0, 9, "old", False, False), ("m", "2", 5, 9, "same", True, False), ("m", "3", 5, 9, "same", True, False), ("m", "4", 7, 9, "p", False, True)]
    s = spark.createDataFrame(rows, "meeting_id string, segment_id string, start_ms long, end_ms long, text string, is_overlap boolean, provisional boolean")
    e = spark.createDataFrame([("m", "1", " new "), ("m", "2", "both"), ("m", "4", "x"), ("m", "9", "x")], "meeting_id string, segment_id string, new_text string")
    edited, refused = tb.edit_texts(s, e)
    assert result(edited, "segment_id", "text") == [("1", "new"), ("2", "both"), ("3", "both"), ("4", "p")]
    assert result(refused, "segment_id", "error") == [("4", "provisional segments cannot be edited"), ("9", "segment not found")]


def test_orphans_keep_their_data(spark):
    m = spark.createDataFrame([("a", "processing", None), ("b", "recording", None), ("c", "stopped", 5.0)], "meeting_id string, status string, stopped_at double")
    live_now = spark.createDataFrame([("b",)], "meeting_id string")
    assert result(tb.heal_orphans(m, live_now, F.lit(9.0)), "meeting_id", "status") == [("a", "stopped"), ("b", "recording"), ("c", "stopped")]


def test_junk_does_not_refine_the_buffer():
    kept = [0, 8000, "a clear sentence about the plan", []]
    from parley.operators.reconcile import best_overlap, refine

    assert best_overlap([kept], 2000, 10_000) is kept
    refine(kept, 2000, 10_000, "zzz", [])
    assert kept == [0, 10_000, "a clear sentence about the plan", []]


def test_merge_words():
    a = [["hello", 0, 1000], ["world", 1000, 2000]]
    b = [["World", 1100, 2100], ["again", 2100, 3000], ["wurld", 1200, 1900]]
    assert rc.merge_words(a, b) == [["hello", 0, 1000], ["world", 1000, 2100], ["again", 2100, 3000]]


def test_activity_sessions_batch(spark):
    rows = [("m", 0), ("m", 300), ("m", 2000)]
    df = spark.createDataFrame(rows, "meeting_id string, ms long").withColumn("at", F.timestamp_millis("ms"))
    assert live.activity_sessions(df, ["meeting_id"], "at", "400 milliseconds").count() == 2


def test_clock_and_budget(spark):
    r = spark.range(1).select(mn.clock(F.lit(3_725_000)).alias("c"), tx.estimate_tokens(F.lit("x" * 19)).alias("t")).first()
    assert (r["c"], r["t"]) == ("62:05", 11)
    assert mn.chunk_chars() == 10_018


def test_clusters_are_named_by_voice_then_time_then_number(spark):
    fresh = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.0, 1.0]), ("m", 2, [-1.0, 0.1]), ("m", 3, [-1.0, -1.0])], "meeting_id string, label int, centroid array<double>")
    known = spark.createDataFrame([("m", "SPEAKER_01", [0.9, 0.1])], "meeting_id string, speaker_id string, centroid array<double>")
    spans = spark.createDataFrame([("m", 0, 0, 100), ("m", 1, 100, 200), ("m", 2, 150, 400), ("m", 3, 900, 950)], "meeting_id string, label int, start_ms long, end_ms long")
    before = spark.createDataFrame([("m", "SPEAKER_01", 100, 200, 1), ("m", "SPEAKER_00", 160, 300, 2), ("m", "SPEAKER_07", 110, 140, 3)],
                                   "meeting_id string, speaker_id string, start_ms long, end_ms long, interval_id long")
    named = rl.relabel_by_voice(fresh, known, spans, before)
    got = {r.label: r.speaker_id for r in named.collect()}
    # 0 by voice; 1 shares 40 ms with SPEAKER_00 and 30 with SPEAKER_07; SPEAKER_00 is then taken; 3 gets the next free number
    assert got == {0: "SPEAKER_01", 1: "SPEAKER_00", 2: "SPEAKER_02", 3: "SPEAKER_03"}
    blended = {r.speaker_id: r.centroid for r in rl.blend_centroids(known, named).collect()}
    assert blended["SPEAKER_01"] == pytest.approx([0.94, 0.06]) and blended["SPEAKER_02"] == [-1.0, 0.1]
    plain = {r.label: r.speaker_id for r in rl.relabel_by_voice(fresh, known).collect()}
    assert plain == {0: "SPEAKER_01", 1: "SPEAKER_00", 2: "SPEAKER_02", 3: "SPEAKER_03"}


def test_one_failing_row_costs_one_answer(spark):
    def model(pdf):
        if (pdf["n"] == 7).any():
            raise ValueError("seven")
        return pdf["n"].astype(str)

    df = spark.range(40).withColumnRenamed("id", "n").coalesce(1)
    rows = {r.n: (r.answer, r.error) for r in hooks.with_model(df, model, "answer", retries=1, backoff=(0.0,)).collect()}
    assert rows == {n: (None, "ValueError: seven") if n == 7 else (str(n), None) for n in range(40)}


def test_short_series_are_not_smoothed(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, "x")]
    df = spark.createDataFrame(rows, "meeting_id string, frame_idx long, label string")
    got = {(r.meeting_id, r.frame_idx): r.smoothed for r in fr.smooth_labels(df, ["meeting_id"], "label").collect()}
    assert got == {("a", 0): "x", ("a", 1): "y", ("b", 0): "x", ("b", 1): "x", ("b", 2): "x"}


def test_summaries_of_all_parts_stay(spark):
    rows = [("m", i, f" part {i} " + "x" * 500 + " ") for i in range(8)] + [("m", 8, "  "), ("m", 9, None), ("n", 0, "short")]
    got = mn.merge_summaries(spark.createDataFrame(rows, "meeting_id string, part long, summary string"))
    assert [tuple(r) for r in got.orderBy("meeting_id", "part").collect()] == [(m, i, s.strip()) for m, i, s in rows if s and s.strip()]
