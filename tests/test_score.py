"""The score's steps that look at parts of a text only, or at many texts at a time, against those that look at each whole."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from parley.functions import hops, quality, text as tx


def odd_texts(n):
    rnd = random.Random(8)
    bits = ["so", "yes", "(music)", "[ noise ]", "【x】", " ", " ", "\x85", "\n", "ا", "ΑΣ", "İ", "10", "_", "...", "(", ")", "[", "ab", "ab" * 6, "abcd" * 6, "‌", "thank you", "music", "𐐀"]
    return [("".join(rnd.choice(bits[: rnd.randrange(2, len(bits) + 1)]) + rnd.choice(["", " ", "\x85", " "]) for _ in range(rnd.choice([0, 1, 2, 4, 20, 40]))),) for _ in range(n)] + [(None,)]


def test_longest_runs_of_many_texts():
    rnd = random.Random(3)
    lists = [[rnd.choice(["a", "b", "ب"]) for _ in range(rnd.randrange(0, 12))] for _ in range(2500)]

    def plain(tokens):
        best = run = 0
        for k, t in enumerate(tokens):
            run = run + 1 if k and t == tokens[k - 1] else 1
            best = max(best, run)
        return best

    assert hops.longest_runs(pa.array(lists)).to_pylist() == [plain(x) for x in lists]
    assert hops.longest_runs(pa.array(lists).slice(7, 1300)).to_pylist() == [plain(x) for x in lists[7:1307]]
    assert hops.longest_runs(pa.array([[], []], pa.list_(pa.string()))).to_pylist() == [0, 0]


def test_parts_tell_as_much_as_whole_texts(spark):
    df = spark.createDataFrame(odd_texts(800), "text string").withColumn("t", F.coalesce("text", F.lit("")))
    df = df.withColumn("c", tx.compact(F.col("t"))).withColumn("k", tx.tokens(F.col("t")))
    rows = df.select(
        tx.may_loop(F.col("t")).alias("may"),
        tx.loop_score(F.col("c")).alias("loop"),
    ).collect()
    assert all(r.may for r in rows if r.loop > 0) and not all(r.may for r in rows)
    bare = F.regexp_replace(F.regexp_replace("t", tx.LABEL_TAG, " "), tx.EVENT_TAG, " ")
    known = F.forall("b", lambda k: tx.boilerplate_key(k).isin(tx.ALL_BOILERPLATE))
    whole = df.withColumn("b", tx.tokens(bare)).withColumn(
        "want", (F.col("t") != "") & ((F.size("b") == 0) | tx.boilerplate_key(F.col("t")).isin(tx.ALL_BOILERPLATE) | ((F.size("b") <= 3) & known))
    )
    flags = tx.with_boilerplate(whole, "t", "k", "got").select("t", "got", "want").collect()
    assert all(r.got == r.want for r in flags) and any(r.got for r in flags) and not all(r.got for r in flags)


def test_a_text_is_cut_into_tokens_once(spark):
    """Neither the gate nor its score goes through the tokens one by one to find runs, and the gate uses those of the score."""
    df = spark.createDataFrame([("so so so it goes", "en")], "text string, language string")
    out = quality.with_gate(df.withColumn("text", F.concat("text", F.lit("."))), "text", F.col("language"))
    assert out.first()["gated_text"] == "so it goes"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_longest_run_udf(") == 1 and "aggregate(" not in plan


def test_phrases_said_twice_go_as_by_patterns():
    """Word by word the same as one pattern per length over the line, the longest first."""
    twice = [re.compile(rf"(?<!\S)(\S++(?: \S++){{{n - 1}}}) \1(?!\S)") for n in range(8, 1, -1)]

    def by_patterns(line):
        before = None
        while line != before:
            before = line
            for pattern in twice:
                line = pattern.sub(r"\1", line)
                if line != before:
                    break
        return line

    rnd = random.Random(2)
    lines = [" ".join(rnd.choice(["ab", "a", "و", "a‌b"][: rnd.randrange(1, 5)]) for _ in range(rnd.randrange(0, 40))) for _ in range(3000)]
    for line in lines:
        words = line.split()
        half = len(words) // 2
        start = words[:half] if len(words) >= 4 and words[:half] * 2 == words else words
        assert hops.collapse_repeats(line) == by_patterns(" ".join(start)), line
    assert not hasattr(hops, "_TWICE")
