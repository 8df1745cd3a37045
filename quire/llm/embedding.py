"""Near-duplicate vectors by an exact metric range join.

Vectors are compared as points of the unit sphere, where a cosine bound is a
distance bound ``r``. Pivots, whose number grows with the square root of a
label's vectors, cut its points into cells by nearest pivot. By the triangle
inequality a point within ``r`` of a member of cell ``p`` lies at most ``r``
beyond the plane halfway between its own pivot and ``p``, so copying the points
in that margin lets every cell be joined alone and each member see all its
links. Cells are joined in bounded blocks; a block gives link counts and a
spanning forest, never the pairs.

Equal vectors are one node with a multiplicity. Pivots are a sample that steers
cost, not results: a cell of any size is a grid of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, forest, whole_runs
from .common import checkpointed
from .components import connected_components, with_component_least

THRESHOLD = 0.98
#: A label of n vectors has about ``LEAST_PIVOTS + PIVOT_SHARE * sqrt(n)`` pivots.
LEAST_PIVOTS = 4
PIVOT_SHARE = 0.25
#: Components of all pivots together: what every task holds (32 MB). Labels beyond it, the smallest first, are one cell each.
PIVOT_FLOATS = 4_194_304
#: Home members, and all members, of a cell that one block holds.
ROW_BLOCK, COLUMN_BLOCK = 4096, 16_384
_SLACK = 1e-6


def usable(vector: str) -> Column:
    """Not null or empty, and all components present and finite."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine, F.lit(False))


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype("f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return units(column.flatten().to_numpy(zero_copy_only=False), dim)


def choose_pivots(nodes: DataFrame, floats: int = PIVOT_FLOATS) -> dict[tuple, np.ndarray]:
    """Unit pivots by (label, dim), picked by a hash of the node: no sort and no window over a label."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    share = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 30)) / (1 << 30)
    picked = nodes.join(sizes, ["label", "dim"]).where((F.col("size") > 1) & (share * F.col("size") < LEAST_PIVOTS + PIVOT_SHARE * F.sqrt("size")))
    widest = nodes.agg(F.max("dim")).first()[0]
    if not widest or floats < widest:
        return {}
    rows = picked.select("label", "dim", "vec", "size", "node").orderBy(F.desc("size"), "label", "dim", "node").limit(floats // widest).select("label", "dim", "vec").toArrow()
    out: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
        out.setdefault(key, []).append(at)
    return {key: _matrix(rows.column(2).take(pa.array(own)), key[1]) for key, own in out.items() if len(own) > 1}


def cell_rows(nodes: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """``(label, dim, pivot, home, node, n, vec)``: each node in its own cell and in those whose margin it is in."""
    label_type = nodes.schema["label"].dataType.simpleString()
    vec_type = nodes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            of: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(labels, dims)):
                of.setdefault(key, []).append(row)
            rows, cells, homes = [], [], []
            for key, own in of.items():
                own = np.array(own)
                p = pivots.get(key)
                if p is None or len(p) < 2:
                    rows.append(own)
                    cells.append(np.zeros(len(own), "i4"))
                    homes.append(np.ones(len(own), bool))
                    continue
                gaps = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
                for at in range(0, len(own), 1024):
                    some = own[at : at + 1024]
                    near = _matrix(batch.column(5).take(pa.array(some)), key[1]) @ p.T
                    home = near.argmax(axis=1)
                    beyond = near[np.arange(len(some)), home][:, None] - near
                    within = beyond <= (radius + _SLACK) * gaps[home] + _SLACK
                    r, c = np.nonzero(within)
                    rows.append(some[r])
                    cells.append(c.astype("i4"))
                    homes.append(home[r] == c)
            if not rows:
                continue
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(homes)), *(batch.column(k).take(rows) for k in (3, 4, 5))], names=["label", "dim", "pivot", "home", "node", "n", "vec"])

    ordered = nodes.select("label", "dim", F.lit(0).alias("zero"), "node", "n", "vec")
    return ordered.mapInArrow(run, f"label {label_type}, dim int, pivot int, home boolean, node string, n long, vec {vec_type}")


def cell_links(placed: DataFrame, threshold: float, row_block: int = ROW_BLOCK, column_block: int = COLUMN_BLOCK) -> DataFrame:
    """``(node, n_links, root)`` by block: links of home members to other nodes, and forest edges."""
    keys = ["label", "dim", "pivot"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("__all"), F.count(F.when(F.col("home"), 1)).alias("__own")).where("__all > 1")
    sized = placed.join(sizes, keys).withColumn("__r", block_count(F.col("__own"), row_block)).withColumn("__c", block_count(F.col("__all"), column_block))
    h = F.xxhash64("node")
    # as a row: one row block and every column block; as a column: the other way round; where both meet, once
    sides = sized.withColumn("__ri", F.pmod(h, F.col("__r")).cast("int")).withColumn("__ci", F.pmod(h, F.col("__c")).cast("int"))
    sides = sides.withColumn("__row", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    cells = (
        sides.withColumn("__o", F.explode(F.sequence(F.lit(0), F.when(F.col("__row"), F.col("__c")).otherwise(F.col("__r")) - 1)))
        .where(F.col("__row") | ~F.col("home") | (F.col("__o") != F.col("__ri")))
        .withColumn("__side", F.when(~F.col("__row"), 1).when(F.col("__o") == F.col("__ci"), 2).otherwise(0))
        .withColumn("__i", F.when(F.col("__row"), F.col("__ri")).otherwise(F.col("__o")))
        .withColumn("__j", F.when(F.col("__row"), F.col("__o")).otherwise(F.col("__ci")))
        .select(*keys, "__i", "__j", "__side", "node", "n", "vec")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_runs(batches, 5):
            side, n, dims = rows.column(5).to_numpy(), rows.column(7).to_numpy(), rows.column(1).to_numpy()
            for at, to in zip(bounds[:-1], bounds[1:]):
                if to - at < 2:
                    continue
                x = _matrix(rows.column(8).slice(at, to - at), int(dims[at]))
                names = np.array(rows.column(6).slice(at, to - at).to_pylist())
                left, right = np.flatnonzero(side[at:to] != 1), np.flatnonzero(side[at:to] != 0)
                known, index = np.unique(names, return_inverse=True)
                count, a, c = np.zeros(len(known), "i8"), [], []
                for k in range(0, len(left), 256):
                    l, r = np.nonzero(x[left[k : k + 256]] @ x[right].T >= threshold)
                    l, r = left[k + l], right[r]
                    other = index[l] != index[r]
                    l, r = l[other], r[other]
                    np.add.at(count, index[l], n[at:to][r])
                    a.append(index[l])
                    c.append(index[r])
                if not sum(map(len, a)):
                    continue
                roots = forest(np.concatenate(a), np.concatenate(c), len(known))
                told = np.flatnonzero((count > 0) | (roots != np.arange(len(known))))
                yield pa.RecordBatch.from_arrays([pa.array(known[told].tolist(), pa.string()), pa.array(count[told]), pa.array(known[roots[told]].tolist(), pa.string())], names=["node", "n_links", "root"])

    by = [*keys, "__i", "__j"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "node string, n_links long, root string")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", pivot_floats: int = PIVOT_FLOATS) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    Only rows with equal, non-null labels (and as many components) link, at a
    cosine of ``threshold`` or more in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Repeated
    rows are vectors of their own. A null id counts only where a component has no
    other; a row without links has its own id. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    x = F.transform(F.col(vector_column), lambda v: v + F.lit(0).cast(vectors.schema[vector_column].dataType.elementType))  # -0.0 becomes 0.0
    fit = usable(vector_column) & F.col(label_column).isNotNull() & F.exists(F.col(vector_column), lambda v: v != 0)
    rows = vectors.select(F.col(id_column).alias("__id"), F.col(label_column).alias("label"), F.when(fit, x).alias("vec"))
    node = F.when(F.col("vec").isNotNull(), F.concat(F.hex(F.xxhash64("label", "vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.size("vec"), "vec", "label"))))
    rows = rows.withColumn("node", node)
    nodes = rows.where("node is not null").groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.count("*").alias("n"), F.min("__id").alias("least"))
    nodes = checkpointed(nodes.withColumn("dim", F.size("vec")))
    pivots = choose_pivots(nodes, pivot_floats)
    links = checkpointed(cell_links(cell_rows(nodes, pivots, math.sqrt(2 - 2 * threshold)), threshold))
    of = connected_components(links.select("node", "root"))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = with_component_least(nodes.select("node", "n", "least"), of).join(counts, "node", "left")
    told = named.select("node", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    linked = rows.where("node is not null").select("__id", "node").join(told, "node")
    alone = rows.where("node is null").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = linked.select("__id", "n_links", "component_id").union(alone)
    return out.select(F.col("__id").alias(id_column), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
