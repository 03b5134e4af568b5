"""Which rows a chain of pointers reaches, by jumps that grow fourfold each round.

Every row names the row that follows it if it is on a chain; some rows begin one.  Walking would
take a step per row reached.  Here a round joins the table of jumps with itself, so that it skips
four times as far as the last, and marks what the rows marked so far reach with it: the rounds are
the logarithm of the longest chain, and each is a few equi-joins whose keys are single rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.plans.kept import keep
from parley.plans.slabs import side_by_side


def reached(pointers: DataFrame, starts: DataFrame, on_round=lambda number: None) -> DataFrame:
    """(key, at) of the starts and all that they lead to.

    `pointers` has (key, at, to), at most one row for (key, at), and leads forward only; `starts` has (key, at), no
    two on one chain.  Keys may be null.  `on_round` is told the number of each round.
    """
    # A text that tells null from all values makes plain equi-joins possible.
    named = lambda df, *cols: df.select(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("-")).alias("k"), "key", *cols)
    jump = keep(named(pointers, "at", "to").drop("key"), "jumps")
    marked = [keep(named(starts, "at"), "marked")]
    number = 0
    while True:
        number += 1
        on_round(number)
        so_far = marked[0]
        for m in marked[1:]:
            so_far = so_far.unionByName(m)
        found, step = [], so_far
        for _ in range(3):
            step = side_by_side(step, jump, ["k", "at"]).select("k", "key", F.col("to").alias("at"))
            found.append(step)
        new = keep(found[0].unionByName(found[1]).unionByName(found[2]), "marked")
        if new.isEmpty():
            return so_far.select("key", "at")
        marked.append(new)
        far = jump
        for _ in range(3):
            beyond = jump.select("k", F.col("at").alias("to"), F.col("to").alias("_next"))
            far = side_by_side(far, beyond, ["k", "to"]).select("k", "at", F.col("_next").alias("to"))
        jump = keep(far, "jumps")


def followed(pointers: DataFrame) -> DataFrame:
    """(at, root): the last row that each pointer (at, to) leads to.  Pointers form no ring; every round they skip
    twice as far."""
    links = keep(pointers.select("at", F.col("to").alias("root"), F.lit(True).alias("_went")), "followed")
    while not links.where("_went").isEmpty():
        beyond = links.select(F.col("at").alias("root"), F.col("root").alias("_beyond"))
        met = side_by_side(links, beyond, "root", "left")
        links = keep(met.select("at", F.coalesce("_beyond", "root").alias("root"), F.col("_beyond").isNotNull().alias("_went")), "followed")
    return links.select("at", "root")
