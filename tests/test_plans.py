"""Plan shapes: rounds of jumps, folds cut at pauses, islands of recordings, state of live meetings."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import hooks
from parley.operators import packing as pk, reconcile as rc, recordings as rec
from parley.plans.carry import carry_fold
from parley.plans.jumps import reached
from parley.plans.kept import keep_by
from parley.streaming import live, stateful
from tests.test_golden import result, segs, turns, windows


# ---- jumps and packing ----------------------------------------------------------------------------


def test_chains_are_followed_in_few_rounds(spark):
    pointers = spark.range(1000).select(F.lit(None).cast("string").alias("key"), F.col("id").alias("at"), (F.col("id") + 3).alias("to")).unionByName(
        spark.range(50).select(F.lit("k").alias("key"), F.col("id").alias("at"), (F.col("id") * 2 + 1).alias("to")))
    starts = spark.createDataFrame([(None, 1), ("k", 0), ("other", 9)], "key string, at long")
    rounds = []
    got = {(r.key, r.at) for r in reached(pointers, starts, rounds.append).collect()}
    assert got == {(None, i) for i in range(1, 1003, 3)} | {("k", i) for i in (0, 1, 3, 7, 15, 31, 63)} | {("other", 9)}
    assert len(rounds) <= 6  # 334 steps: a factor of four a round, and one to see the end


def greedy(sizes, limit, overhead, pieces):
    """Numbers of the chunks that items begin in, one item after the other."""
    out, chunk, used = [], 0, None
    for n in sizes:
        cost = n if pieces else n + overhead
        more = cost + overhead if pieces else cost
        if n > limit:
            out.append(chunk + 1)
            chunk, used = chunk + (-(-n // limit) if pieces else 1), None
        elif used is None or used + more > limit:
            chunk, used = chunk + 1, cost
            out.append(chunk)
        else:
            used += more
            out.append(chunk)
    return out


@pytest.mark.parametrize("pieces", [True, False])
def test_chunks_equal_the_greedy_ones(spark, pieces):
    rnd = random.Random(6)
    keys = {None: [rnd.randrange(0, 130) for _ in range(300)], "same": [20] * 400, "big": [500, 0, 0, 101, 100, 99, 3, 1000], "zero": [0] * 50, "one": [7], "edge": [100, 0, 97, 3, 52, 48, 60]}
    rows = [(k, 10 * i - 5, "x" * n) for k, sizes in keys.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k string, pos long, text string").repartition(5)
    rounds = []
    overhead = 1 if pieces else 48
    packed = pk._pack(df, "k", "pos", F.length("text"), 100, overhead, pieces, 40, rounds.append)
    got = {}
    for r in packed.orderBy("pos").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {k: greedy(sizes, 100, overhead, pieces) for k, sizes in keys.items()}
    assert len(rounds) <= 6


# ---- folds --------------------------------------------------------------------------------------


def test_pauses_need_no_second_round(spark):
    """Rows of many slabs with a pause here and there are folded once; without pauses slabs hand on."""
    def fold(carry, rows, end):
        total, out = carry or 0, []
        for i in rows["i"]:
            total += int(i)
            out.append((int(i), total))
        return out, total if end is not None else None

    out = T.StructType([T.StructField("i", T.LongType()), T.StructField("total", T.LongType())])
    at = [i + 100 * (i // 7) for i in range(60)]
    df = spark.createDataFrame([("m", i) for i in at], "k string, i long")
    rounds = []
    carry_fold(df, ["k"], ["i"], 1000, fold, out, 10, F.col("i"), 50, rounds.append)
    assert rounds == []
    whole = result(carry_fold(df, ["k"], ["i"], 1000, fold, out, 10, F.col("i"), 500, rounds.append), "i", "total")
    assert rounds and whole == [(i, sum(at[: k + 1])) for k, i in enumerate(at)]


# ---- recordings ------------------------------------------------------------------------------------


def talk(spark, n, seed):
    rnd = random.Random(seed)
    vocabulary = "plan budget team week review launch design data next call agree point".split()
    at, said, heard = 0, [], []
    for _ in range(n):
        at += rnd.choice([1500, 1500, 1500, 5000, 20_000])
        said.append((at, at + 2000, " ".join(rnd.choices(vocabulary, k=rnd.randrange(2, 9))), []))
    at = 0
    while at < said[-1][1]:
        end = at + rnd.randrange(300, 9000)
        heard.append((rnd.choice("ABC"), at, end))
        at = end + rnd.choice([-1500, -400, 0, 700, 6000])
    return windows(spark, *said), turns(spark, *heard)


@pytest.mark.parametrize("seed", [1, 2])
def test_islands_do_not_change_the_segments(spark, seed):
    w, t = talk(spark, 45, seed)
    t = t.withColumn("is_overlap", F.lit(False)) if "is_overlap" not in t.columns else t
    cols = ["start_ms", "end_ms", "speaker_id", "text", "is_overlap"]
    whole = result(rc.dedupe_segments(rc.align_windows(w, t, ["meeting_id"]), ["meeting_id"]), *cols)
    cut = rec.with_islands(w)
    assert cut.select("island").distinct().count() > 3
    assert result(rec.to_segments(w, t), *cols) == whole


def test_buckets_are_read_without_a_shuffle(spark):
    kept = keep_by(spark.range(100).select((F.col("id") % 7).alias("k"), "id"), ["k"])
    other = keep_by(spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = kept.join(other, "k").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and sorted(r.n for r in met.collect()) == [14, 14, 14, 14, 14, 15, 15]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("slab, halo", [(10, 4), (17, 4), (1000, 50)])
def test_one_speaker_over_many_slabs(spark, slab, halo):
    """A speaks in every call but under other names, B in some; the slabs don't show in the turns."""
    import pandas as pd

    who = "".join("AB"[(i // 3) % 2] if i % 40 < 25 else "A" for i in range(100))
    df = spark.createDataFrame([("m", i, w) for i, w in enumerate(who)] + [("n", 0, "Z")], "meeting_id string, frame_idx long, who string")

    def model(pdf):
        heard = pdf["who"].to_numpy()
        at = pdf["frame_idx"].to_numpy()
        cut = [0, *[k for k in range(1, len(heard)) if heard[k] != heard[k - 1]], len(heard)]
        local = {w: f"{int(at[0])} {k}" for k, w in enumerate(dict.fromkeys(heard))}  # names that only this call knows
        return pd.DataFrame([(local[heard[a]], int(at[a]) * 100, int(at[b - 1]) * 100 + 100) for a, b in zip(cut, cut[1:])], columns=["speaker_id", "start_ms", "end_ms"])

    rows = hooks.diarize(df, model, slab, halo).where("meeting_id = 'm'").collect()
    spoken = {}
    for r in rows:
        for t in range(r.start_ms // 100, r.end_ms // 100):
            assert t not in spoken
            spoken[t] = r.speaker_id
    assert {spoken[i] for i, w in enumerate(who) if w == "A"} == {"SPEAKER_00"}
    assert all(spoken[i] != "SPEAKER_00" for i, w in enumerate(who) if w == "B")
    runs = 1 + sum(a != b for a, b in zip(who, who[1:]))
    assert len(rows) == runs


def test_answers_are_joined_back(spark):
    import pandas as pd

    df = spark.createDataFrame([(None, 1, 1, "a"), (None, 1, 2, "b"), (None, 2, 3, "c"), ("k", 1, 1, "d"), ("k", 2, 2, "e"), ("k", 3, 7, "f")], "k string, batch long, item long, text string")
    answers = {1: '{"items": [{"id": 1, "action": " Fix ", "text": "x"}, {"id": 1, "action": "drop"}, {"id": 99, "action": "drop"}]}', 2: "no idea", 3: 'Sure: {"items": [{"id": 7, "action": "drop"}]} ok'}
    asked = hooks.ask_batches(df, "k", "batch", "item", "text", lambda pdf: pd.Series([answers[b] for b in pdf["batch"]]))
    got = {(r.k, r.item): (r.text, r.action, r.edited) for r in asked.collect()}
    assert got == {(None, 1): ("a", "fix", "x"), (None, 2): ("b", "keep", ""), (None, 3): ("c", "keep", ""), ("k", 1): ("d", "fix", "x"), ("k", 2): ("e", "keep", ""), ("k", 7): ("f", "drop", "")}


# ---- live state -------------------------------------------------------------------------------------

WINDOW = "meeting_id string, start_ms long, end_ms long, text string, words array<struct<word:string,start_ms:bigint,end_ms:bigint>>, window_id long"


def stream_of(spark, rows, folder, files):
    each = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * each : (k + 1) * each], WINDOW)
        part.coalesce(1).write.parquet(f"{folder}/in/batch={k:03d}")
    return spark.readStream.schema(WINDOW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/batch=*")


@pytest.mark.parametrize("files", [1, 12])
def test_state_of_a_meeting_stays_small(spark, tmp_path, files):
    rows = [("m", i * 8000, i * 8000 + 10_000, f"words number {i} " + "same text of all " * (i % 3), [], i) for i in range(36)]
    stream = stream_of(spark, rows, tmp_path, files)
    out = live.run_available(stateful.refined_rows(stream, ["meeting_id"]), "update")
    newest = live.latest_batch(out, ["meeting_id", "row_id"])
    assert result(newest, "row_id", "start_ms", "end_ms") == [(i, i * 8000, i * 8000 + 10_000) for i in range(36)]
    # All rows are closed but those that the next window may still refine, and only these are kept.
    assert [r.row_id for r in newest.where("not closed").orderBy("row_id").collect()] == [34, 35]
    assert max(r.n for r in out.groupBy("batch").agg(F.count("*").alias("n")).collect()) <= 36 // files + 2


@pytest.mark.parametrize("folder", [False, True])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from parley.catalog.live import s15

    parts = [pa.table({"conv_id": [k, k], "turn": [0, 1], "role": ["system", "user"], "text": ["a", None]}) for k in range(3)]
    if folder:
        (tmp_path / "conversations.parquet").mkdir()
        for k, part in enumerate(parts):
            pq.write_table(part, tmp_path / "conversations.parquet" / f"part-{k}.parquet")
    else:
        pq.write_table(pa.concat_tables(parts), tmp_path / "conversations.parquet")
    got = s15(spark, str(tmp_path))
    assert result(got, "meeting_id", "turn", "event_type") == [(str(k), t, e) for k in range(3) for t, e in ((0, "warning"), (1, "transcript"))]


def test_stateful_queries_run_from_any_folder(tmp_path):
    """The worker that prepares a stateful processor finds the package where the session was started elsewhere."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as e
from parley.session import local_session
print(e.queries()["x2_refine_buffer"](local_session(2), "/root/testdata/sf0.001").count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PARLEY_DRIVER_MEMORY": "2g"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_sessions_end_by_the_clock_or_the_log(spark):
    minute = 60_000
    log = [("a", 0, "active"), ("a", 1, "left"), ("a", 3, "active"), ("a", 4, "left"), ("a", 30, "active"), ("a", 31, "stop"), ("a", 32, "left"),
           ("b", 0, "stop"), ("b", 2, "active"), ("b", 90, "active"), ("c", 5, "active"), ("c", 6, "left"), ("d", 88, "active"), ("d", 89, "left")]
    df = spark.createDataFrame([(m, (t + 1000) * minute, c, i) for i, (m, t, c) in enumerate(log)], "meeting_id string, at_ms long, command string, event_id long")
    path = live.shared_folder(spark, "log")
    df.withColumn("at", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = live.run_available(stateful.ended_sessions(stream, 10 * minute, event_time=True)).drop("batch")
    want = [("a", 0, 14, "left", 4), ("a", 30, 31, "stop", 2), ("c", 5, 16, "left", 2)]
    assert sorted((r.meeting_id, r.started_ms // minute - 1000, r.ended_ms // minute - 1000, r.reason, r.n_events) for r in got.collect()) == want


def test_capture_goes_on_after_a_restart(spark):
    """Half of the frames, then a new query on the same checkpoint once all are there: every frame once."""
    from parley.catalog.live import captured

    sf = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    folder = live.shared_folder(spark, "capture")

    def run(available):
        query = captured(spark, sf, available).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        query.trigger(availableNow=True).start().awaitTermination()
        return result(spark.read.parquet(f"{folder}/out"), "first_sample", "speaker_id")

    half = run(total // 2)
    assert len(half) == total // 2
    whole = run(None)
    assert len(whole) == total and set(half) <= set(whole) and [n for n, _ in whole] == list(range(0, 2 * total, 2))
    assert run(None) == whole
