"""Near-duplicates by SimHash fingerprints and pigeonring search.

A fingerprint holds, for each of 64 bits, whether more than half of a text's
shingle hashes have it set. Fingerprints of at most ``radius`` differing bits
link. Candidates come from pigeonring filtering: of a ring of ``segments`` bit
segments with differences that sum to at most ``radius``, some segment starts a
chain whose sums over 1, 2, ... segments all stay within the proportional
budget ``length * radius / segments``. While that budget is below one the chain's
segments must be equal, so these are the index key: 4 segments in a row of 9, 28
bits, at radius 2. The longer chains are tested before the full distance.

Equal fingerprints are one node. Nodes that share a key are compared in
bounded blocks that emit a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import forest, gridded, whole_runs
from .common import checkpointed, small_slices, texts_or_empty
from .components import connected_components, with_component_least

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 9
#: Fingerprints of a block.
FP_BLOCK = 8192
_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of their 8 x 8 bits set."""
    h = hashes.view("u1").reshape(-1, 8)
    if len(h) < 200:
        return np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype="i8").reshape(8, 8)
    return np.stack([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes have set."""
    return int.from_bytes(np.packbits(counts.reshape(64) * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text; without words it is zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return 0
    counts, n = np.zeros((8, 8), "i8"), max(1, len(words) - shingle + 1)
    for at in range(0, n, 65536):
        own = words[at : at + 65536 + shingle - 1]
        if len(own) > shingle:
            shingles = map(b" ".join, zip(*(own[k:] for k in range(shingle))))
        else:
            shingles = iter([b" ".join(own)])
        counts += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8"))
    return majority(counts, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long. A null text counts as empty."""
    keep = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            fp = [fingerprint(t, shingle, seed) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.array(fp, "u8").view("i8"))], names=[*keep, "__fp"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "__fp long"
    return docs.select(texts_or_empty(text_column).alias("__text"), *keep).mapInArrow(run, schema)


def segment_masks(segments: int) -> list[int]:
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def hamming_links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = FP_BLOCK) -> DataFrame:
    """Links ``(u, v)`` that join the distinct fingerprints of ``nodes(fp)`` as all pairs within ``radius`` would."""
    if not 0 <= radius < segments <= 32:
        raise ValueError("pigeonring needs 0 <= radius < segments <= 32")
    masks = segment_masks(segments)
    equal = (segments - 1) // radius if radius else segments  # how long a chain has no budget
    ring = lambda start, length: sum(masks[(start + k) % segments] for k in range(length))
    chains = [[(np.uint64(ring(s, k)), k * radius // segments) for k in range(equal + 1, segments + 1)] or [(np.uint64(2**64 - 1), radius)] for s in range(segments)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (ring(s, equal) for s in range(segments))]
    keyed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("val")) for s, m in enumerate(signed)))).alias("k")).select("k.seg", "k.val", "fp")
    cells = gridded(keyed, ["seg", "val"], F.xxhash64("fp"), block).select("seg", "val", "__i", "__j", "__b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_runs(batches, 4):
            seg, i, j, b, fp = (rows.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
            us, vs = [], []
            for at, to in zip(bounds[:-1], bounds[1:]):
                if to - at < 2:
                    continue
                own = fp[at:to]
                x = own.view("u8")
                if i[at] == j[at]:
                    left = right = np.arange(to - at)
                else:
                    left, right = np.flatnonzero(b[at:to] == i[at]), np.flatnonzero(b[at:to] == j[at])
                a, c, near = [], [], chains[seg[at]]
                for k in range(0, len(left), 256):
                    xor = x[left[k : k + 256], None] ^ x[None, right]
                    l, r = np.nonzero(np.bitwise_count(xor & near[0][0]) <= near[0][1])
                    for mask, budget in near[1:]:
                        keep = np.bitwise_count(xor[l, r] & mask) <= budget
                        l, r = l[keep], r[keep]
                    a.append(left[k + l])
                    c.append(right[r])
                roots = forest(np.concatenate(a), np.concatenate(c), to - at)
                moved = np.flatnonzero(roots != np.arange(to - at))
                us.append(own[moved])
                vs.append(own[roots[moved]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    keys = ["seg", "val", "__i", "__j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id reached
    over links, its own included. A null or wordless text has fingerprint zero and
    links like any other. Null ids count only where a component has no other (then
    its id is null); repeated rows come out repeated; other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, shingle, seed, text_column, [id_column]).select(F.col(id_column).alias("__id"), F.col("__fp").alias("fp")))
    nodes = fps.groupBy("fp").agg(F.min("__id").alias("least"))
    of = connected_components(hamming_links(nodes.select("fp"), radius, segments))
    named = with_component_least(nodes.withColumnRenamed("fp", "node"), of).select(F.col("node").alias("fp"), "component_id")
    return fps.join(named, "fp").select(F.col("__id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def ranked_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``__row``, ``__text``, ``__rank`` and ``__rest`` of each row.

    Nulls, and ids that are no whole numbers, rank last; rows of one id by text
    hash. ``__rest`` orders rows that are equal in both.
    """
    number = F.col(id_column).try_cast("long")
    rank = F.struct(number.isNull().alias("n"), F.coalesce(number, F.lit(0)).alias("i"), F.xxhash64(text_column).alias("t"))
    others = F.to_json(F.struct(*(c for c in docs.columns if c != text_column))) if len(docs.columns) > 1 else F.lit("")
    return docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_column).alias("__text"), rank.alias("__rank"), others.alias("__rest"))


def first_rows(rows: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """The columns of one row for each rank in ``kept(least)``; of rows with one rank the first by all other columns."""
    chosen = rows.join(kept.select(F.col("least").alias("__rank")), "__rank").select("__row", "__rank", "__rest")
    once = chosen.withColumn("__n", F.row_number().over(Window.partitionBy("__rank").orderBy("__rest"))).where("__n = 1")
    return once.select(*(F.col(f"__row.`{c}`").alias(c) for c in names))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns: the one of the smallest id.

    Nulls rank last among ids; of repeated rows of one id the one of the smallest
    text hash stays.
    """
    rows = ranked_rows(docs, id_column, text_column)
    fps = checkpointed(fingerprints(rows.select("__text", "__rank"), shingle, seed, "__text", ["__rank"]).select(F.col("__rank").alias("rank"), F.col("__fp").alias("fp")))
    nodes = fps.groupBy("fp").agg(F.min("rank").alias("least"))
    of = connected_components(hamming_links(nodes.select("fp"), radius, segments))
    kept = nodes.join(of, nodes.fp == of.node, "left").select("least", F.coalesce("component", "fp").alias("c")).groupBy("c").agg(F.min("least").alias("least"))
    return first_rows(rows, kept, docs.columns)
