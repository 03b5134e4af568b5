"""Word and speaker error rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType

from parley.functions import text as tx
from parley.operators.intervals import clipped_edges
from parley.plans.slabs import SLAB_MS

#: Tokens of the reference whose differences are held in the bits of one number.
BLOCK = 4096


def edit_distance(a: list[str], b: list[str], block: int = BLOCK) -> int:
    """Fewest inserted, deleted and replaced tokens, by differences of neighbouring cells held in bits.

    A column of the table of distances differs from cell to cell by at most one, so two numbers hold it; a token of b
    moves a whole column on with a few operations.  The column is cut into blocks, which hand the difference at their
    lower edge to the next, so numbers stay small and memory linear.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    across = [1] * len(b)  # how much the row above grows with each token of b
    for at in range(0, len(a), block):
        own = a[at : at + block]
        places: dict[str, int] = {}
        for i, token in enumerate(own):
            places[token] = places.get(token, 0) | (1 << i)
        full, last = (1 << len(own)) - 1, len(own) - 1
        up, down = full, 0  # cells that are one more, and one less, than the cell above them
        for j, token in enumerate(b):
            same, step = places.get(token, 0), across[j]
            vertical = same | down
            if step < 0:
                same |= 1
            level = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(level | up)), up & level
            across[j] = (more >> last & 1) - (less >> last & 1)
            more, less = (more << 1 | (step > 0)) & full, (less << 1 | (step < 0)) & full
            up, down = less | (full & ~(vertical | more)), more & vertical
    return len(a) + sum(across)


@F.pandas_udf(IntegerType())
def _edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(a), list(b)) for a, b in zip(ref, hyp)], dtype="int32")


def with_word_errors(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Add n_words and n_edits (token edit distance); the rate is edits over reference words.

    Distances of recordings of any length are exact: they take a few seconds for 100,000 words.
    """
    words = lambda c: tx.words(F.lower(F.coalesce(F.col(c), F.lit(""))))
    df = df.withColumn("_r", words(ref)).withColumn("_h", words(hyp))
    edits, n = F.col("n_edits"), F.size("_r")
    rate = F.when(n > 0, edits / n).otherwise((F.size("_h") > 0).cast("double"))
    return df.withColumn("n_edits", _edits("_r", "_h")).withColumn("n_words", n).withColumn("wer", rate).drop("_r", "_h")


def speaker_error_rate(
    reference: DataFrame, hypothesis: DataFrame, keys: list[str], step_ms: int = 100, bin_ms: int = SLAB_MS
) -> DataFrame:
    """Share of grid instants whose set of speakers differs, per key.

    Nothing is evaluated instant by instant: between two edges the sets do not
    change, and [a, b) holds ceil(b/step) - ceil(a/step) grid points.  The sets
    differ while some speaker is heard on one side only, so counting such
    speakers is enough.  Bins are swept on their own and their counts add up.
    """
    both = reference.select(*keys, "speaker_id", "start_ms", "end_ms", F.lit(1).alias("is_ref")).unionByName(
        hypothesis.select(*keys, "speaker_id", "start_ms", "end_ms", F.lit(0).alias("is_ref"))
    )
    edges = clipped_edges(both, keys, ["speaker_id", "is_ref"], bin_ms)
    one = W.partitionBy(*keys, "_bin", "speaker_id").orderBy("t")
    upto, before = one.rangeBetween(W.unboundedPreceding, 0), one.rangeBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy(*keys, "_bin", "speaker_id", "t").orderBy("d")) == 1

    def heard(side: int, w) -> Column:
        return F.coalesce(F.sum(F.when(F.col("is_ref") == side, F.col("d"))).over(w), F.lit(0)) > 0

    for name, w in (("now", upto), ("was", before)):
        edges = edges.withColumn(f"_r_{name}", heard(1, w)).withColumn(f"_h_{name}", heard(0, w))

    def change(test) -> Column:
        now = test(F.col("_r_now"), F.col("_h_now")).cast("int")
        was = test(F.col("_r_was"), F.col("_h_was")).cast("int")
        return F.when(first, now - was).otherwise(0)

    edges = edges.withColumn("_differ", change(lambda r, h: r != h)).withColumn("_any", change(lambda r, h: r | h))
    in_bin = W.partitionBy(*keys, "_bin").orderBy("t")
    total = in_bin.rangeBetween(W.unboundedPreceding, 0)
    nxt = F.lead("t").over(W.partitionBy(*keys, "_bin").orderBy("t", "d", "speaker_id", "is_ref"))
    points = F.ceil(F.col("_next") / step_ms) - F.ceil(F.col("t") / step_ms)
    pieces = (
        edges.withColumn("_d", F.sum("_differ").over(total))
        .withColumn("_u", F.sum("_any").over(total))
        .withColumn("_next", F.coalesce(nxt, F.col("t")))
    )
    return (
        pieces.groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("_u") > 0, points).otherwise(0)).alias("scored"),
            F.sum(F.when(F.col("_d") > 0, points).otherwise(0)).alias("errors"),
        )
        .withColumn("der", F.when(F.col("scored") > 0, F.col("errors") / F.col("scored")).otherwise(0.0))
    )
