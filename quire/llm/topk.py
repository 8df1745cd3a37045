"""Exact top-k by inner product with norm-bucketed retrieval.

Every query first meets the longest vectors, a set of bounded size that all
tasks hold; its k-th best score there is a floor under its k-th best of all.
Candidates are grouped by length (Euclidean norm) into buckets. A query goes only
to buckets whose longest vector could reach its floor, and a bucket that no query
needs is not moved at all. Buckets and queries meet in blocks of bounded size.

In a bucket, a query's threshold over the lengths of query and candidates is its
local cosine threshold: above one it is done; near one it is cut by the feasible
range of the query's largest coordinate, else by length. What is left is verified
by exact products. The best k of all buckets are merged by a windowed rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_runs
from .common import checkpointed
from .embedding import usable

K = 10
SCALE = 1024
#: Components of a bucket's candidates, of a block's queries, and of the longest vectors that give the floors.
BUCKET_FLOATS = 2_097_152
QUERY_FLOATS = 131_072
SEED_FLOATS = 262_144
#: Candidates looked at between two thresholds, and norm groups.
STEP = 1024
NORM_GROUPS = 64
#: A query whose feasible coordinate range is narrower than this prunes by it, else by length.
NARROW = 1.2


def scaled(flat: np.ndarray, dim: int, scale: int = SCALE) -> np.ndarray:
    return np.floor(flat.astype("f8") * scale).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in double while they fit, else in Python integers, held at the long range."""
    if len(q) == 0 or len(x) == 0 or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype("i8")
    exact = [[int(v) for v in row] for row in x]
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(sum(int(a) * b for a, b in zip(row, other)), low), high) for other in exact] for row in q], "i8").reshape(len(q), len(x))


def _paired(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact products of single pairs."""
    out = np.zeros(len(rows), "i8")
    for at in range(0, len(rows), 16_384):
        r, c = rows[at : at + 16_384], columns[at : at + 16_384]
        if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
            out[at : at + 16_384] = np.einsum("ij,ij->i", q[r], x[c])
        else:
            out[at : at + 16_384] = [_products(q[i : i + 1], x[j : j + 1])[0, 0] for i, j in zip(r, c)]
    return out


class _Best:
    """The k best (score, id) of each query so far, none below its floor; ties go to the smaller id."""

    def __init__(self, floors: np.ndarray, k: int):
        n = len(floors)
        self.scores = np.full((n, k), np.iinfo("i8").min, "i8")
        self.ids = np.full((n, k), np.iinfo("i8").max, "i8")
        self.filled = np.zeros((n, k), bool)
        self.floors = floors  # longs; the least long where nothing is known

    def thresholds(self) -> np.ndarray:
        """A score that one of the k best of all has to reach, as a double; minus infinity for none."""
        own = np.maximum(np.where(self.filled[:, -1], self.scores[:, -1], self.floors), self.floors)
        return np.where(own == np.iinfo("i8").min, -np.inf, own.astype("f8"))

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs sorted by their row."""
        bar = np.maximum(np.where(self.filled[:, -1], self.scores[:, -1], self.floors), self.floors)
        fits = scores >= bar[rows]
        rows, ids, scores = rows[fits], ids[fits], scores[fits]
        k = self.scores.shape[1]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for at, to in zip(starts, [*starts[1:], len(rows)]):
            row = rows[at]
            s = np.concatenate([self.scores[row][self.filled[row]], scores[at:to]])
            i = np.concatenate([self.ids[row][self.filled[row]], ids[at:to]])
            top = np.lexsort((i, -1 - s))[:k]  # -1 - s reverses the order of all longs without overflow
            self.scores[row, : len(top)], self.ids[row, : len(top)], self.filled[row, : len(top)] = s[top], i[top], True


def search_bucket(qx: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = STEP, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(query index, id, score)`` of each query's k best in one bucket that reach its floor, and the products computed."""
    order = np.lexsort((ids, -(x * x).sum(axis=1)))
    x, ids = x[order], ids[order]
    norms, qnorms = np.sqrt((x * x).sum(axis=1)), np.sqrt((qx * qx).sum(axis=1))
    focus = np.abs(qx).argmax(axis=1)
    unit = qx[np.arange(len(qx)), focus] / np.maximum(qnorms, 1e-300)
    best = _Best(np.full(len(qx), np.iinfo("i8").min) if floors is None else floors, k)
    computed = 0
    for at in range(0, len(x), step):
        some, own_ids, lengths = x[at : at + step], ids[at : at + step], norms[at : at + step]
        kth = best.thresholds()
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qnorms * lengths[0] > 0, kth / (qnorms * lengths[0]), np.where(kth > 0, np.inf, -np.inf))
            need = np.where(qnorms > 0, kth / qnorms, np.where(kth > 0, np.inf, -np.inf)) * (1 - 1e-9)
        alive = np.flatnonzero(local <= 1 + 1e-9)
        if not len(alive):
            if (kth > -np.inf).all():
                break  # later candidates are shorter still
            continue
        reached = np.searchsorted(-lengths, -need[alive], side="right")  # by length: a prefix
        use = np.arange(len(some))[None, :] < reached[:, None]
        t = np.minimum(local[alive], 1)
        spread = np.sqrt(np.maximum((1 - t * t) * (1 - unit[alive] ** 2), 0)) + 1e-9
        low = np.where(-unit[alive] >= t, -1.0, unit[alive] * t - spread)  # the range of a unit vector's coordinate at that cosine or more
        high = np.where(unit[alive] >= t, 1.0, unit[alive] * t + spread)
        narrow = np.flatnonzero((t > 0) & (high - low < NARROW) & (reached > 0))
        if len(narrow):
            inside = some[:, focus[alive[narrow]]].T / np.maximum(lengths, 1e-300)
            use[narrow] = (inside >= low[narrow, None] - 1e-9) & (inside <= high[narrow, None] + 1e-9)
        use &= qid[alive][:, None] != own_ids[None, :]
        kept, pairs = np.flatnonzero(use.any(axis=0)), int(use.sum())
        if pairs * 16 < len(alive) * len(kept):
            r, c = np.nonzero(use)
            scores = _paired(qx[alive], some, r, c)
            computed += pairs
        elif len(kept):
            r, c = np.nonzero(use[:, kept])
            scores, c = _products(qx[alive], some[kept])[r, c], kept[c]
            computed += len(alive) * len(kept)
        else:
            continue
        best.offer(alive[r], own_ids[c], scores)
    q, r = np.nonzero(best.filled)
    return q, best.ids[q, r], best.scores[q, r], computed


def floors_of(qx: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some candidates; the least long if they are fewer."""
    out = np.full(len(qx), np.iinfo("i8").min)
    for at in range(0, len(qx), 256):
        own = np.where(qid[at : at + 256, None] != ids[None, :], _products(qx[at : at + 256], x), np.iinfo("i8").min)
        if own.shape[1] >= k:
            out[at : at + 256] = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(column.flatten().to_numpy(zero_copy_only=False), dim, scale)


def with_floors(queries: DataFrame, rows: DataFrame, k: int, scale: int, seeds: int) -> DataFrame:
    """Queries ``(dim, norm, id, vec)`` with ``floor``, from the ``seeds`` longest rows of all."""
    longest = rows.orderBy(F.desc("norm"), "id", "dim").limit(seeds).select("dim", "id", "vec").toArrow()
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    dims = longest.column(0).to_numpy()
    for dim in np.unique(dims).tolist():
        own = longest.filter(pa.array(dims == dim))
        held[dim] = _matrix(own.column(2), dim, scale), own.column(1).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                floors, of = np.full(part.num_rows, np.iinfo("i8").min), part.column(0).to_numpy()
                for dim in np.unique(of).tolist():
                    if dim in held:
                        own = np.flatnonzero(of == dim)
                        floors[own] = floors_of(_matrix(part.column(3).take(pa.array(own)), dim, scale), part.column(2).to_numpy()[own], *held[dim], k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floors)], names=["dim", "norm", "id", "vec", "floor"])

    kind = queries.schema["vec"].dataType.simpleString()
    return queries.select("dim", "norm", "id", "vec").mapInArrow(run, f"dim int, norm double, id long, vec {kind}, floor long")


def top_k(vectors: DataFrame, k: int = K, every: int = 100, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", bucket_floats: int = BUCKET_FLOATS, query_floats: int = QUERY_FLOATS, seed_floats: int = SEED_FLOATS) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best of all rows for each query.

    Queries are the rows whose id is divisible by ``every``; components become
    ``floor(scale * x)``; ties go to the smaller id; a query's own id is no
    candidate. Vectors that are null or empty, or hold null or non-finite
    components, and null ids take no part. Only vectors with as many components
    as the query are candidates; scores beyond a long are held at its range.
    Repeated rows of one id are candidates of their own and one query, that of
    the smallest vector. Other columns are ignored.
    """
    rows = vectors.where(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec")).withColumn("dim", F.size("vec"))
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.floor(v.cast("double") * scale).cast("double") * F.floor(v.cast("double") * scale).cast("double"))
    rows = checkpointed(rows.withColumn("norm", F.sqrt(length)))
    told = rows.agg(F.percentile_approx("norm", [g / NORM_GROUPS for g in range(1, NORM_GROUPS)], 200).alias("edges"), F.max("dim").alias("widest")).first()
    edges = sorted(set(told.edges or []))
    group = F.lit(len(edges))
    for g in reversed(range(len(edges))):
        group = F.when(F.col("norm") < edges[g], F.lit(g)).otherwise(group)
    grouped = rows.withColumn("g", group)
    asking = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "dim", "norm")).alias("q")).select("q.dim", "q.norm", "id", "q.vec")
    queries = checkpointed(with_floors(asking, rows, k, scale, max(1, seed_floats // (told.widest or 1))))
    # a row for each norm group and number of components
    buckets = grouped.groupBy("dim", "g").agg(F.max("norm").alias("longest"), F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") / bucket_floats)).cast("int").alias("parts"))
    could = F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("floor")
    routed = queries.join(buckets, "dim").where(could).select("dim", "g", "parts", "id", "vec", "floor")
    blocks = routed.groupBy("dim", "g", "parts").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") / query_floats)).cast("int").alias("blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = grouped.join(blocks, ["dim", "g"]).withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int")).withColumn("qb", spread("blocks"))
    asked = routed.join(blocks.select("dim", "g", "blocks"), ["dim", "g"]).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", spread("parts"))
    keys = ["dim", "g", "part", "qb"]
    sides = candidates.select(*keys, F.lit(1).alias("side"), "id", "vec", F.lit(0).cast("long").alias("floor")).unionByName(asked.select(*keys, F.lit(0).alias("side"), "id", "vec", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, 4):
            side, ids, dims, floors = table.column(4).to_numpy(), table.column(5).to_numpy(), table.column(0).to_numpy(), table.column(7).to_numpy()
            for at, to in zip(bounds[:-1], bounds[1:]):
                own, asking = np.flatnonzero(side[at:to] == 1), np.flatnonzero(side[at:to] == 0)
                if not len(own) or not len(asking):
                    continue
                x, i = _matrix(table.column(6).slice(at, to - at), int(dims[at]), scale), ids[at:to]
                q, found, score, _ = search_bucket(x[asking], i[asking], x[own], i[own], k, floors=floors[at:to][asking])
                yield pa.RecordBatch.from_arrays([pa.array(i[asking][q]), pa.array(found), pa.array(score)], names=["query_id", id_column, "score"])

    found = sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"query_id long, `{id_column}` long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_column, "score")
