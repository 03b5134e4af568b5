"""Ordered folds over keys of any size.

Some results depend on what the row before has become (merging text into the row
kept last).  Where speech pauses nothing can be handed over: rows are cut into
islands there, and a slab is some neighbouring islands, folded on its own and
exactly.  Only an island longer than a slab is cut inside.  Its slabs are first
folded as if nothing were handed over; afterwards those that were handed something
else are folded again, until nothing changes, which is the sequential result.

Every round is written to the session's checkpoint folder, so a lost executor
costs tasks of the running round only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from parley.plans.kept import keep
from parley.plans.slabs import Run, running, side_by_side, slab_of

# fold(carry, rows, end): `rows` are sorted; `end` is the first order value of the next slab
# (None where nothing is handed on, so that everything must be closed).
Fold = Callable[[object, pd.DataFrame, int | None], tuple[list[tuple], object]]

SLAB_ROWS = 20_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by number, or by these columns: adaptive execution would put little data into one task, however
    long its rows take."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def in_groups(df: DataFrame, by: list[str], order: list[str], run: Callable[[list, pd.DataFrame], list[tuple]], out: T.StructType) -> DataFrame:
    """The columns `by` and what `run` makes of the rows of each of their groups, sorted by `order`, nulls last.

    As groupBy().applyInPandas(), but neighbouring groups go to Python together: most are a few rows, and handing each
    over alone takes longer than its work.  A task holds a batch and the group it is in.
    """
    key_schema = T.StructType([df.schema[c] for c in by])
    named = df.withColumn("_group", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    order_by = [F.col(c).asc_nulls_last() for c in order]
    schema = T.StructType([T.StructField("_group", T.StringType()), *out.fields])

    def finished(group: str, parts: list[pd.DataFrame]) -> list[tuple]:
        rows = (parts[0] if len(parts) == 1 else pd.concat(parts)).reset_index(drop=True)
        return [(group, *r) for r in run(list(json.loads(group).values()), rows)]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda data: pd.DataFrame(data, columns=schema.names, dtype=object)
        group, parts = "", []
        for batch in batches:
            if not len(batch):
                continue
            names, data = batch.pop("_group").to_numpy(dtype=object), []
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for at, until in zip(cuts, cuts[1:]):
                if parts and names[at] != group:
                    data += finished(group, parts)
                    parts = []
                group = names[at]
                parts.append(batch.iloc[at:until])
            yield table(data)
        if parts:
            yield table(finished(group, parts))

    sorted_rows = dealt(named, "_group").sortWithinPartitions("_group", *order_by)
    done = sorted_rows.mapInPandas(runs, schema).withColumn("_group", F.from_json("_group", key_schema))
    return done.select(*[F.col(f"_group.{c}").alias(c) for c in by], *out.names)


def in_slabs(rows: DataFrame, keys: list[str], order: list[str], coarse: int, slab_rows: int, end: Column | None, pause: int) -> tuple[DataFrame, bool]:
    """The rows, and whether any slab begins inside an island.  Adds `_slab`, about `slab_rows` neighbouring rows, and `_inside`: the slab begins inside an island.

    An island begins where a row's first order value is over `pause` beyond every `end` before it; without `end`, where a
    key begins.  Rows before the first island that begins in a slab stay with the slab before.
    """
    at = F.col(order[0]).cast("long")
    runs = [Run("_rank", "sum", F.lit(1))]
    if end is not None:
        runs.append(Run("_reach", "max", end.cast("long"), inclusive=False))
    ranked = running(rows.withColumn("_coarse", slab_of(F.col(order[0]), coarse)), keys, "_coarse", order, runs).drop("_coarse")
    begins = F.col("_rank") == 1 if end is None else F.col("_reach").isNull() | (at > F.col("_reach") + pause)
    ranked = keep(ranked.withColumn("_begins", begins).withColumn("_part", F.floor((F.col("_rank") - 1) / slab_rows)).drop("_reach"), "ranked")
    firsts = ranked.groupBy(*keys, "_part").agg(F.min(F.when(F.col("_begins"), F.col("_rank"))).alias("_first"))
    firsts = keep(firsts, "firsts")
    any_inside = not firsts.where(F.col("_first").isNull()).isEmpty()
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_part"]], "_first")
    same = F.lit(True)
    for k in [*keys, "_part"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = side_by_side(ranked, firsts, same).drop(*[f"_k_{k}" for k in [*keys, "_part"]])
    slab = F.when(F.col("_rank") < F.col("_first"), F.col("_part") - 1).otherwise(F.col("_part"))
    # Rows that went back to the slab before say nothing about how it begins.
    return met.select(*rows.columns, slab.alias("_slab"), F.col("_first").isNull().alias("_inside")), any_inside


def carry_fold(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    coarse: int,
    fold: Fold,
    out: T.StructType,
    slab_rows: int = SLAB_ROWS,
    end: Column | None = None,
    pause: int = 0,
    on_round: Callable[[int], None] = lambda number: None,
) -> DataFrame:
    """Fold the rows of each key in `order`, which must be total; its first column is a number.

    `coarse` is the width of the first column's steps used to count rows.  `end` and `pause` say where islands begin
    (see in_slabs): the fold must hand nothing on there.  `on_round` is told the number of each round after the first.
    """
    key_fields = [rows.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [T.StructField("_slab", T.LongType()), T.StructField("_used", T.StringType()), T.StructField("_left", T.StringType())]
        + list(out.fields)
    )
    blank = [None] * len(out.fields)

    def folded(head: list, pdf: pd.DataFrame, used: str, end: int | None) -> pd.DataFrame:
        closed, carry = fold(json.loads(used), pdf.sort_values(order, kind="stable"), end)
        data = [(*head, None, None, *r) for r in closed]
        left = json.dumps(carry, ensure_ascii=False)
        return pd.DataFrame([*data, (*head, used, left, *blank)], columns=schema.names).astype(object)

    def alone(group: list, pdf: pd.DataFrame) -> list[tuple]:
        return fold(None, pdf, None)[0]

    def within(group: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        until = state["_end"].iloc[0]
        return folded([*group[:-1], int(group[-1])], pdf, state["_carry"].iloc[0], None if pd.isna(until) else int(until))

    by = [*keys, "_slab"]
    src, any_inside = in_slabs(rows, keys, order, coarse, slab_rows, end, pause)
    if not any_inside:
        return keep(in_groups(src.drop("_inside"), by, order, alone, out).select(*keys, *out.names), "folded")

    # Slabs of long islands: the first one of the island hands on to those that begin inside it.
    src = keep(src, "slabs")
    slabs = src.groupBy(*by).agg(F.max("_inside").alias("_inside"), F.min(F.when(F.col("_inside"), F.col(order[0]).cast("long"))).alias("_from"))
    chain = W.partitionBy(*keys).orderBy("_slab")
    after = lambda c: F.lead(c).over(chain)
    slabs = slabs.withColumn("_next", F.when(after("_inside"), after("_slab"))).withColumn("_end", F.when(after("_inside"), after("_from")))
    slabs = keep(slabs.drop("_from"), "chain")
    data = src.drop("_inside")

    def fold_round(todo: DataFrame, number: int) -> DataFrame:
        todo = todo.select(*[F.col(c).alias(c) for c in [*by, "_carry", "_end"]])
        part = side_by_side(data, todo.select(*by), by, "left_semi")
        done = dealt(part, *by).groupBy(*by).cogroup(dealt(todo, *by).groupBy(*by)).applyInPandas(within, schema)
        return keep(done.withColumn("_round", F.lit(number)), "folded")

    number = 0
    results = fold_round(slabs.withColumn("_carry", F.lit("null")), number)
    while True:
        states = results.where(F.col("_left").isNotNull())
        newest = states.groupBy(*by).agg(F.max_by(F.struct("_used", "_left"), "_round").alias("s"), F.max("_round").alias("_round"))
        handed = newest.join(slabs.select(*by, "_next"), by).where(F.col("_next").isNotNull()).select(
            *keys, F.col("_next").alias("_slab"), F.col("s._left").alias("_carry")
        )
        todo = (
            handed.join(newest.select(*by, F.col("s._used").alias("_used")), by)
            .where(F.col("_carry") != F.col("_used"))
            .join(slabs.select(*by, "_end"), by)
        )
        if todo.isEmpty():
            break
        number += 1
        on_round(number)
        results = results.unionByName(fold_round(todo, number))
    done = results.join(newest.select(*by, "_round"), [*by, "_round"], "left_semi")
    return done.where(F.col("_left").isNull()).select(*keys, *out.names)
