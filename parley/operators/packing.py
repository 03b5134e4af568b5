"""Greedy packing of ordered text into budgets, and worst-first selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.quality import needs_polish
from parley.functions.text import strip
from parley.plans.jumps import reached
from parley.plans.kept import keep
from parley.plans.slabs import Run, running, side_by_side, slab_of

# Default budgets.
BATCH_CHARS, ITEM_OVERHEAD = 10_000, 48
SLAB_ROWS = 20_000


def _pack(
    items: DataFrame, key: str, pos: str, size: Column, limit: int, overhead: int, pieces: bool, slab_rows: int,
    on_round=lambda number: None,
) -> DataFrame:
    """Add `chunk`, the number (from 1) of the greedy chunk in which each item starts.

    Only positions and sizes are looked at.  An item over the limit stands alone; with `pieces` it
    takes as many chunks as it fills.  With `pieces` the overhead is the separator, charged from
    the second item on; otherwise every item pays it.

    With running sums of what the items cost, the chunk that begins at an item ends before the
    first item whose sum is beyond a threshold.  One sort of sums and thresholds together finds
    that item for every item, whether it begins a chunk or not; which of them do is what the first
    item, and each one behind an item over the limit, reaches along these pointers.
    """
    n = size.cast("long")
    big = n > limit
    cost = n if pieces else n + overhead
    more = cost + overhead if pieces else cost
    own = items.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("at"), n.alias("n"), big.alias("big"), cost.alias("cost"), more.alias("more"))
    # An item over the limit raises the sum beyond all thresholds before it.
    own = own.withColumn("more", F.when(F.col("big"), F.col("cost") + limit + overhead).otherwise(F.col("more"))).withColumn("_slab", slab_of(F.col("at"), slab_rows))
    summed = keep(running(own, ["key"], "_slab", ["at"], [Run("upto", "sum", F.col("more")), Run("behind", "last", F.col("big"))]).drop("_slab"), "sums")
    until = F.col("upto") + F.greatest(F.lit(0), F.lit(limit) - F.col("cost"))
    none = F.lit(None).cast("struct<at:bigint,big:boolean>")
    edges = summed.select("key", F.col("upto").alias("value"), F.lit(0).alias("kind"), "at", F.struct("at", "big").alias("item")).unionByName(
        summed.where(~F.col("big")).select("key", until.alias("value"), F.lit(1).alias("kind"), "at", none.alias("item"))
    ).withColumn("_slab", slab_of(F.col("value"), slab_rows * 16))
    led = running(edges, ["key"], "_slab", ["value", "kind", "at"], [Run("to", "next", F.col("item"))])
    pointers = led.where((F.col("kind") == 1) & ~F.col("to.big")).select("key", "at", F.col("to.at").alias("to"))
    heads = reached(pointers, summed.where(~F.col("big") & F.coalesce("behind", F.lit(True))).select("key", "at"), on_round)
    parts = F.ceil(F.col("n") / F.lit(limit)) if pieces else F.lit(1).cast("long")
    begun = summed.where("big").select("key", "at", parts.alias("starts")).unionByName(heads.select("key", "at", F.lit(1).cast("long").alias("starts")))
    # Chunks begun before an item and with it, in the order of their items.
    counted = summed.select("key", "at", F.lit(0).cast("long").alias("starts")).unionByName(begun).groupBy("key", "at").agg(F.sum("starts").alias("starts"))
    numbered = running(counted.withColumn("_slab", slab_of(F.col("at"), slab_rows)), ["key"], "_slab", ["at"], [Run("_last", "sum", F.col("starts"))])
    first = F.when(F.col("starts") > 0, F.col("_last") - F.col("starts") + 1).otherwise(F.col("_last"))
    numbered = numbered.select(F.col("key").alias("_key"), F.col("at").alias("_at"), first.alias("chunk"))
    return side_by_side(items, numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col(pos).cast("long") == F.col("_at"))).drop("_key", "_at")


def split_lines(lines: DataFrame, key: str, pos: str, line: str, limit: int, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Cut an ordered text into chunks of at most `limit` characters at line ends.

    One row per line, or per piece of a line that is too long; a chunk is the pieces of
    its number in (pos, piece) order joined by newlines.
    """
    n = F.length(line)
    packed = _pack(lines, key, pos, n, limit, 1, True, slab_rows)
    count = F.greatest(F.ceil(n / F.lit(limit)), F.lit(1))
    return packed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn(
        "text", F.when(n > limit, F.substring(F.col(line), F.col("piece") * limit + 1, F.lit(limit))).otherwise(F.col(line))
    ).withColumn("chunk", F.col("chunk") + F.col("piece")).drop(line)


def fold_overflow(chunks: DataFrame, limit: int) -> DataFrame:
    """At most `limit` parts: everything behind goes to the last one, as further chunks of that part."""
    return chunks.withColumn("part", F.least(F.col("chunk"), F.lit(limit)))


def batch_items(
    items: DataFrame, key: str, pos: str, text: str, limit: int = BATCH_CHARS, slab_rows: int = SLAB_ROWS
) -> DataFrame:
    """Number the greedy batches of review items; an item over the limit is a batch of its own."""
    return _pack(items, key, pos, F.length(text), limit, ITEM_OVERHEAD, False, slab_rows).withColumnRenamed("chunk", "batch")


def first_batches(batched: DataFrame, limit: int) -> DataFrame:
    """A report on the first batches of each key."""
    return batched.where(F.col("batch") <= limit)


def worst_items(texts: DataFrame, key: str, text: str, order: str, limit: int | None = None) -> DataFrame:
    """The distinct texts per key that need polish, worst first and ranked; `order` breaks ties. `limit`: only so many.

    Copies are merged map-side, and Spark keeps only the top rows of a key before the shuffle.
    """
    # The test is applied to the aggregate: filtering first would make Spark compute the whole
    # score a second time below the filter.
    at = F.when(needs_polish(F.col("score"), F.col("reasons")), F.col(order))
    tidy = texts.withColumn(text, strip(F.col(text))).withColumn("_at", at)
    one = tidy.groupBy(key, text).agg(F.min("_at").alias(order), F.min_by("score", "_at").alias("score"))
    one = one.where(F.col(order).isNotNull() & (F.col(text) != ""))
    rank = F.row_number().over(W.partitionBy(key).orderBy("score", order))
    ranked = one.withColumn("rank", rank)
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
