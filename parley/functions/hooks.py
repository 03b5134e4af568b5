"""User models as operators: any function from a batch of rows to a batch of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from parley.plans.carry import dealt, in_groups
from parley.plans.jumps import followed
from parley.plans.kept import keep
from parley.plans.slabs import islands, side_by_side, slab_of

# Waits before the second, third and later tries.
BACKOFF_S = (0.5, 1.0, 2.0)
# Rows of a call: an Arrow batch of long prompts would be held once more for its answers.
CALL_ROWS = 256

Model = Callable[[pd.DataFrame], pd.Series]


def with_model(
    df: DataFrame, model: Model, answer: str, retries: int = 3, backoff: tuple[float, ...] = BACKOFF_S
) -> DataFrame:
    """Add a model's text answer per row, and `error` and `tries`.

    A batch that fails is tried again with growing waits; if it fails for good it is halved,
    and each half gets one more try, down to single rows: only rows that fail alone stay
    without an answer, with their error.  Put cheap filters before this step.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(answer, T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())]
    )

    def asked(batch: pd.DataFrame, tries: int, limit: int) -> Iterator[pd.DataFrame]:
        result, error = None, None
        for turn in range(limit):
            if turn:
                time.sleep(backoff[min(turn, len(backoff)) - 1])
            tries += 1
            try:
                result, error = list(model(batch)), None
                break
            except Exception as e:  # whatever a user's model raises ends up in the error column
                error = f"{type(e).__name__}: {e}"
        if error is not None and len(batch) > 1:
            half = len(batch) // 2
            yield from asked(batch.iloc[:half], tries, 1)
            yield from asked(batch.iloc[half:], tries, 1)
            return
        out = batch.copy()
        out[answer] = pd.Series([None] * len(batch) if result is None else result, index=batch.index, dtype=object)
        out["error"], out["tries"] = error, tries
        yield out

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CALL_ROWS):
                yield from asked(batch.iloc[at : at + CALL_ROWS], 0, retries + 1)

    return df.mapInPandas(call, schema)


ANSWER = "struct<items:array<struct<id:bigint,action:string,text:string>>>"


def parsed_answer(answer: Column) -> Column:
    """The items of a model's JSON answer, also where other text stands around the object; null if there is none."""
    whole = F.from_json(answer, ANSWER)["items"]
    inside = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), ANSWER)["items"]
    return F.coalesce(whole, inside)


def ask_batches(
    items: DataFrame, key: str, batch: str, item: str, text: str, model: Model, retries: int = 3, backoff: tuple[float, ...] = BACKOFF_S
) -> DataFrame:
    """`items` with `action` and `edited` as a model answered for their batch.

    The model gets a row per (key, batch) with `prompt`, a JSON list of {"id", "text"}, and answers
    {"items": [{"id", "action", "text"}]}.  Only the first answer for an id counts, ids that were not asked are ignored,
    and items without an answer (left out, or in a broken or failed one) are kept as they are.  A batch is what
    `batch_items` lets into one call, so its prompt is bounded by that budget.
    """
    asked = F.struct(F.col(item).cast("long").alias("id"), F.col(text).alias("text"))
    # Dealt by number: prompts shrink much when shuffled, and few tasks would hold all of them.
    prompts = dealt(items, key, batch).groupBy(key, batch).agg(F.to_json(F.array_sort(F.collect_list(asked))).alias("prompt"))
    answered = with_model(prompts, model, "answer", retries, backoff)
    each = answered.select(F.col(key).alias("_key"), F.col(batch).alias("_batch"), F.posexplode(parsed_answer(F.col("answer"))).alias("_pos", "_a"))
    first = each.groupBy("_key", "_batch", F.col("_a.id").alias("_id")).agg(F.min_by("_a", "_pos").alias("_a"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(batch) == F.col("_batch")) & (F.col(item).cast("long") == F.col("_id"))
    action = F.lower(F.trim(F.col("_a.action")))
    known = F.when(action.isin("keep", "fix", "drop"), action).otherwise("keep")
    joined = side_by_side(items, first, same, "left")
    return joined.withColumn("action", known).withColumn("edited", F.coalesce("_a.text", F.lit(""))).drop("_key", "_batch", "_id", "_a")


# ---- diarizers --------------------------------------------------------------------------------


def diarize(
    frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], slab_frames: int = 200_000, halo_frames: int = 3_000, frame_ms: int = 100
) -> DataFrame:
    """Turns (meeting_id, speaker_id, start_ms, end_ms) from a user's diarizer, run per slab of a recording.

    A call sees its slab and `halo_frames` on both sides, and names speakers as it likes.  Two neighbouring calls both
    hear the time around their border: names that share most of it, each the other's best, are one speaker, and
    what is joined over all borders has one id in the meeting, numbered by first appearance.  Someone who is
    silent around a border gets a new id behind it; `relabel_by_voice` can join these.  Turns are cut at the borders
    and joined again where they touch, so the size of the slabs does not show.
    """
    i = F.col("frame_idx")
    near = F.sequence(F.greatest(F.lit(0), F.floor((i - halo_frames) / slab_frames)), F.floor((i + halo_frames) / slab_frames))
    spread = frames.withColumn("slab", F.explode(near))

    def run(key: list, pdf: pd.DataFrame) -> list[tuple]:
        if not (pdf.pop("slab").to_numpy() == pdf["frame_idx"].to_numpy() // slab_frames).any():
            return []  # the recording ends before this slab
        turns = model(pdf)
        return list(zip(turns["speaker_id"], *[turns[c].to_numpy().astype("int64").tolist() for c in ("start_ms", "end_ms")]))

    spans = T.StructType([T.StructField("name", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
    heard = keep(in_groups(spread, ["meeting_id", "slab"], ["frame_idx"], run, spans), "heard")
    slab_ms, halo_ms = slab_frames * frame_ms, halo_frames * frame_ms

    def around(border: Column, side: str) -> DataFrame:
        at = border * slab_ms
        start, end = F.greatest("start_ms", at - halo_ms), F.least("end_ms", at + halo_ms)
        return heard.select("meeting_id", border.alias("border"), F.col("name").alias(side), start.alias(f"{side}_start"), end.alias(f"{side}_end")).where(F.col(f"{side}_start") < F.col(f"{side}_end"))

    both = side_by_side(around(F.col("slab") + 1, "a"), around(F.col("slab"), "b"), ["meeting_id", "border"])
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    ms = both.where(shared > 0).groupBy("meeting_id", "border", "a", "b").agg(F.sum(shared).alias("ms"))
    # ties go to the names that sort first
    best = lambda of, other: ms.groupBy("meeting_id", "border", of).agg(F.min(F.struct((-F.col("ms")).alias("ms"), other))[other].alias(other))
    links = side_by_side(best("a", "b"), best("b", "a"), ["meeting_id", "border", "a", "b"])
    node = lambda slab, name: F.to_json(F.struct(F.col("meeting_id"), slab.alias("slab"), F.col(name).alias("name")))
    roots = followed(links.select(node(F.col("border"), "b").alias("at"), node(F.col("border") - 1, "a").alias("to")))
    low, high = F.col("slab") * slab_ms, (F.col("slab") + 1) * slab_ms
    cut = heard.select("meeting_id", node(F.col("slab"), "name").alias("at"), F.greatest("start_ms", low).alias("start_ms"), F.least("end_ms", high).alias("end_ms")).where("start_ms < end_ms")
    named = keep(side_by_side(cut, roots, "at", "left").select("meeting_id", F.coalesce("root", "at").alias("who"), "start_ms", "end_ms"), "named")
    first = named.groupBy("meeting_id", "who").agg(F.min(F.struct("start_ms", "end_ms")).alias("first"))
    number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("first", "who")) - 1
    ids = first.select("meeting_id", "who", F.concat(F.lit("SPEAKER_"), F.lpad(number.cast("string"), 2, "0")).alias("speaker_id"))
    turns = side_by_side(named, ids, ["meeting_id", "who"]).withColumn("_slab", slab_of(F.col("start_ms")))
    return islands(turns, ["meeting_id", "speaker_id"], "_slab", ["start_ms", "end_ms"], "start_ms", "end_ms", 0).drop("n_rows")
