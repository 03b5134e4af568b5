"""Running values over a key that may be too large for one task.

A plain window partitioned by meeting puts a whole meeting into one task.  Here
a meeting is cut into slabs (a fixed width of its own order column); the window
runs inside (key, slab), one small row per slab is aggregated map-side, and only
these slab rows are scanned per key to find what each slab inherits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.plans.kept import keep

SLAB_MS = 600_000


def side_by_side(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input, as a merge of their sorted partitions.

    Spark takes the bytes of files for the size of what is read from them, although equal texts, exploded rows and
    aggregates take many times that in memory, and would gather such a table in the driver to broadcast it.
    """
    return left.join(right.hint("merge"), on, how)


def slab_of(col: Column, width: int = SLAB_MS) -> Column:
    return F.floor(col / F.lit(width)).cast("long")


def in_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds `_slab`, the number of the range of `by` that a row is in; ranges hold about equally many rows and are
    written as they were dealt, so that the numbers stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(parts, *by).withColumn("_slab", F.spark_partition_id().cast("long")), "ranges")


@dataclass(frozen=True)
class Run:
    """One running value: kind is sum, max, min, last or next.

    `inclusive` counts the current row; last/next never do.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _same(cols: list[str]) -> Column:
    """Null-safe equality of columns with their `_k_` twins."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return cond


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def running(
    df: DataFrame, keys: list[str], slab: str, order: list[str], runs: list[Run]
) -> DataFrame:
    """Add running values in `order` over `keys`; `order` must be total and agree with `slab`."""
    src = df
    for r in runs:
        src = src.withColumn(f"_v_{r.name}", r.value)
    at = F.struct(*[F.col(c) for c in order])
    totals = []
    for r in runs:
        v = F.col(f"_v_{r.name}")
        if r.kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_t_{r.name}"))
        elif r.kind == "next":
            totals.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_t_{r.name}"))
        else:
            totals.append(_AGG[r.kind](v).alias(f"_t_{r.name}"))
    per_slab = src.groupBy(*keys, slab).agg(*totals)

    before = W.partitionBy(*keys).orderBy(slab).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.col(slab).desc()).rowsBetween(W.unboundedPreceding, -1)
    inherited = []
    for r in runs:
        t = F.col(f"_t_{r.name}")
        if r.kind == "last":
            c = F.last(t, ignorenulls=True).over(before)
        elif r.kind == "next":
            c = F.last(t, ignorenulls=True).over(after)
        else:
            c = _AGG[r.kind](t).over(before)
        inherited.append(c.alias(f"_c_{r.name}"))
    carried = per_slab.select(*keys, slab, *inherited)

    # Keys may be null (turns before the first flagged one), so compare null-safely.
    carried = carried.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, slab]], *[f"_c_{r.name}" for r in runs])
    out = side_by_side(src, carried, _same([*keys, slab])).drop(*[f"_k_{c}" for c in [*keys, slab]])
    asc = W.partitionBy(*keys, slab).orderBy(*order)
    desc = W.partitionBy(*keys, slab).orderBy(*[F.col(c).desc() for c in order])
    for r in runs:
        v, c = F.col(f"_v_{r.name}"), F.col(f"_c_{r.name}")
        if r.kind in ("last", "next"):
            w = (asc if r.kind == "last" else desc).rowsBetween(W.unboundedPreceding, -1)
            val = F.coalesce(F.last(v, ignorenulls=True).over(w), c)
        else:
            w = asc.rowsBetween(W.unboundedPreceding, 0 if r.inclusive else -1)
            val = _MERGE[r.kind](_AGG[r.kind](v).over(w), c)
        out = out.withColumn(r.name, val)
    return out.drop(*[f"_v_{r.name}" for r in runs], *[f"_c_{r.name}" for r in runs])


def islands(
    df: DataFrame,
    keys: list[str],
    slab: str,
    order: list[str],
    start: str,
    end: str,
    gap: int,
) -> DataFrame:
    """Merge rows whose start lies within `gap` of everything before them: one row per run.

    A run ends at the reach found by the head of the next run, so only the
    heads take part in the second pass.
    """
    reach = running(
        df, keys, slab, order,
        [Run("_reach", "max", F.col(end).cast("long"), inclusive=False), Run("_rank", "sum", F.lit(1))],
    )
    heads = reach.where(
        F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap)
    ).select(*keys, slab, *dict.fromkeys([*order, start]), "_reach", "_rank").withColumn(
        "_here", F.struct("_reach", "_rank")
    )
    heads = running(heads, keys, slab, order, [Run("_next", "next", F.col("_here"))])
    whole = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.max(F.col(end).cast("long")).alias("_last"), F.count(F.lit(1)).alias("_all")
    )
    return side_by_side(heads, whole, _same(keys)).select(
        *keys,
        F.col(start).cast("long").alias(start),
        F.coalesce("_next._reach", "_last").alias(end),
        (F.coalesce(F.col("_next._rank"), F.col("_all") + 1) - F.col("_rank")).alias("n_rows"),
    )
