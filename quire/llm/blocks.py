"""Join groups in bounded blocks instead of gathering them whole.

A group of any size becomes a grid of cells of at most ``2 * BLOCK`` rows. The
cells of one group land in different tasks; each task sees one cell at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def block_count(rows: Column, block: int = BLOCK) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(block))).cast("int")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by their first ``keys`` columns: tables of whole groups, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        rows = rows.combine_chunks()
        differs = np.zeros(max(0, rows.num_rows - 1), bool)
        for i in range(keys):
            x = rows.column(i).to_numpy(zero_copy_only=False)
            differs |= x[1:] != x[:-1]
        return rows, np.concatenate([[0], np.flatnonzero(differs) + 1, [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = ([held[k].column(i)[at].as_py() for i in range(keys)] for k, at in ((0, 0), (-1, batch.num_rows - 1)))
        if first == last:  # still one group
            continue
        rows, bounds = cut(pa.Table.from_batches(held))
        yield rows.slice(0, bounds[-2]), bounds[:-1]
        held = rows.slice(bounds[-2]).to_batches()
    if held:
        yield cut(pa.Table.from_batches(held))


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def gridded(rows: DataFrame, keys: list[str], spread: Column, block: int = BLOCK, member: str | None = None, piece: str | None = None) -> DataFrame:
    """Rows of a self-join, each in the cells ``(i, j)``, i <= j, that its block ``b`` takes part in.

    Only groups of two rows or more stay; a group within one block has the cell
    (0, 0). With ``member``, a column that no group holds twice, groups of the same
    members are compared once: the one of the smallest key stands for all. With
    ``piece``, groups whose rows are all of one piece are left out.
    """
    same = [F.bit_xor(F.xxhash64(F.lit(k), member)).alias(f"__x{k}") for k in (0, 1)] if member else []
    ends = [F.min(piece).alias("__p0"), F.max(piece).alias("__p1")] if piece else []
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *same, *ends).where("__n > 1").where("__p0 < __p1" if piece else "true").drop("__p0", "__p1")
    if member:
        sizes = sizes.groupBy("__n", "__x0", "__x1").agg(F.min(F.struct(*keys)).alias("__k")).select("__k.*", "__n")
    placed = rows.join(sizes, keys).withColumn("__s", block_count(F.col("__n"), block)).withColumn("__b", F.pmod(spread, F.col("__s")).cast("int"))
    cells = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    return cells.withColumn("__i", F.least("__b", "__o")).withColumn("__j", F.greatest("__b", "__o")).drop("__n", "__s", "__o")
