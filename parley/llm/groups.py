"""Comparison of the rows that share a key, without forming their pairs as rows.

Keys of many rows are split: their rows go to cells (i, j) of a triangle, so that every two rows meet in just one cell
and no cell holds more than a set number of rows or so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one cell compares.
CELL_ROWS = 4096
BATCH_ROWS = 1 << 17
#: Pairs that are held before they are handed on.
HELD_PAIRS = 1 << 18


def in_cells(df: DataFrame, key: Column, count: Column, spread: Column) -> DataFrame:
    """Adds `cell`, `part` and `across`. Rows with a key share `count`, an upper bound or estimate of their number;
    `spread` is any number that tells them apart. Cells are named by a hash; two under one name are compared for nothing."""
    parts = F.greatest(F.lit(1), F.ceil(count / F.lit(CELL_ROWS / 2))).cast("int")
    df = df.withColumn("_parts", parts).withColumn("part", F.pmod(F.xxhash64(spread), "_parts").cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cell = F.xxhash64(key, F.least("part", "_other"), F.greatest("part", "_other"))
    return df.withColumn("cell", cell).withColumn("across", F.col("part") != F.col("_other")).drop("_other", "_parts")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream sorted by cell, in batches of some size that no cell crosses."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < BATCH_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cell = whole.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield from whole.slice(0, cut).to_batches()
        held, size = whole.slice(cut).to_batches(), len(cell) - cut
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of differing bits of 64-bit numbers."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)


def meetings(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later, earlier) places of all rows of equal group, by distance; group is sorted."""
    distance, later = 1, np.arange(1, len(group))
    while len(later):
        later = later[later >= distance]
        later = later[group[later] == group[later - distance]]
        if len(later):
            yield later, later - distance
        distance += 1


def compared(df: DataFrame, order: list[str], ids: list[str], schema: str,
             fits: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], first: int | None = None,
             unpacked: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] = lambda c: c) -> DataFrame:
    """For rows of a cell that `fits` accepts (columns, later, earlier): the later's `ids` and the earlier's.

    `fits` gives 0 for rows that don't fit, 1 for such that may match and 2 for such that very likely do. With `first`,
    a row that has likely partners is given with the earliest of them and the earliest of all, another row with so many
    of the earliest; the cell follows, and whether there were `more`. df has cell, part and across, perhaps only after
    `unpacked`; rows are ordered by `order` within a cell.
    """
    names = df.columns

    def given(columns: dict[str, np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], number: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        later, earlier = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(2))
        if len(later):
            both = [pa.array(columns[n][at]) for at in (later, earlier) for n in ids]
            if number is not None:
                tried = np.bincount(later, minlength=len(number))
                both += [pa.array(columns["cell"][later]), pa.array(number[later] > tried[later])]
            yield pa.RecordBatch.from_arrays(both, [*(f"later_{n}" for n in ids), *(f"earlier_{n}" for n in ids), *(["cell", "more"] if number is not None else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            columns = unpacked({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
            found: list[tuple[np.ndarray, np.ndarray]] = []
            number = np.zeros(batch.num_rows, np.int64)
            likely, latest = (np.full(batch.num_rows, -1) for _ in range(2))
            best = np.full((batch.num_rows, first or 1), -1, np.int32)
            split, held = columns["across"].any(), 0
            for later, earlier in meetings(columns["cell"]):
                fit = fits(columns, later, earlier)
                ok = fit > 0
                if split:
                    ok &= ~columns["across"][later] | (columns["part"][later] != columns["part"][earlier])
                later, earlier, fit = later[ok], earlier[ok], fit[ok]
                if not len(later):
                    continue
                if first is None:
                    found.append((later, earlier))
                    held += len(later)
                    if held >= HELD_PAIRS:
                        yield from given(columns, found, None)
                        found, held = [], 0
                    continue
                # partners come nearest first, so the last ones are the earliest
                best[later, number[later] % first] = earlier
                latest[later] = earlier
                likely[later[fit > 1]] = earlier[fit > 1]
                number[later] += 1
            if first is not None:
                sure = np.flatnonzero(likely >= 0)
                other = sure[latest[sure] != likely[sure]]
                best[sure] = -1
                at = np.nonzero(best >= 0)
                found += [(sure, likely[sure]), (other, latest[other]), (at[0], best[at].astype(np.int64))]
            yield from given(columns, found, None if first is None else number)

    return df.repartition("cell").sortWithinPartitions("cell", *order).mapInArrow(work, schema)
