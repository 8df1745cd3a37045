"""Near-duplicates by SimHash and pigeonring search, then exact Jaccard similarity: the pipeline's measure.

Texts of equal shingle sets are one node. A node has the SimHash fingerprint of
its set; pigeonring search (as in op7, at a wider radius) joins fingerprints of at
most ``RADIUS`` differing bits to groups. The nodes of a group are compared by
their whole shingle sets in bounded blocks that emit a spanning forest, never the
pairs.

Bits differ by chance: at similarity 0.8 sets differ in 9.7 bits on average and in
more than ``RADIUS`` often. What is similar beyond it is found by ``BANDS`` keys, each
of ``ROWS`` minima of the shingle hashes under different mixings, and compared in
the same way; at similarity 0.8 a pair shares no key with probability
(1 - 0.8 ** ROWS) ** BANDS, 0.000027. Groups of a key that fingerprints have joined
already are left out, and groups of the same nodes are compared once.

Shingle sets are made anew for candidates alone. A bitmap of fixed size tells
which rows to read; its false hits cost time and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, gridded, whole_runs
from .common import checkpointed, small_slices, texts_or_empty
from .components import connected_components
from .simhash import bit_counts, first_rows, hamming_links, majority, ranked_rows

SHINGLE = 5
THRESHOLD = 0.8
SEED = 42
RADIUS = 10
SEGMENTS = 11
BANDS = 20
ROWS = 4
_WORDS = 65_536  # of the bitmap, 64 bits each
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), "u8") * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles of a text; fewer words than a shingle has are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # as in op7
    if not words:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8"))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set, as a signed long."""
    fp = majority(bit_counts(hashes), len(hashes))
    return fp - (1 << 64) if fp >> 63 else fp


def can_link(size: int, threshold: float = THRESHOLD) -> bool:
    """Whether a set of that size can be similar to any other: at best to itself and one shingle more."""
    return size / (size + 1) >= threshold


def band_keys(hashes: np.ndarray, bands: int = BANDS) -> list[int]:
    """The keys under which a shingle set is found; an empty one has none."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, ((hashes[at : at + 4096, None] ^ _MIX[0]) * _MIX[1]).min(0))
    return [xxhash.xxh3_64_intdigest(own.tobytes(), k) - 2**63 for k, own in enumerate(low.reshape(BANDS, ROWS)[:bands])]


def similar_roots(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """For each set the first one that it reaches over pairs of at least ``threshold``."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    ids = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    having = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]  # rows by shingle
    counts = np.bincount(ids)
    starts = np.cumsum(counts) - counts
    roots = np.full(n, -1)
    for first in range(n):
        if roots[first] >= 0:
            continue
        roots[first] = first
        rest, stack = np.flatnonzero(roots < 0), [first]
        while stack and len(rest):
            a = stack.pop()
            own = ids[ends[a] - sizes[a] : ends[a]]
            c = counts[own]
            rows = having[np.repeat(starts[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            shared = np.bincount(rows, minlength=n)[rest]
            near = rest[shared / (sizes[a] + sizes[rest] - shared) >= threshold]
            roots[near] = first
            stack += near.tolist()
            rest = rest[roots[rest] < 0]
    return roots


def fingerprint_groups(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``(key, node)`` of ``nodes(node, fp)``: fingerprints that links of at most ``radius`` bits join have one key."""
    marked = nodes.where("fp is not null").select("fp", "node")
    of = connected_components(hamming_links(marked.select("fp").distinct(), radius, segments)).toDF("fp", "c")
    return marked.join(of, "fp", "left").select(F.coalesce("c", "fp").alias("key"), "node")


def similar_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that join ``nodes(node, least)`` as all similar pairs of one group would.

    ``docs`` has ``__rank`` and ``__text``, ``groups`` has ``key`` and ``node``; if it has
    ``piece``, nodes of one piece are joined already.
    """
    piece = "piece" if "piece" in groups.columns else None
    cells = checkpointed(gridded(groups, ["key"], F.xxhash64("node"), block, "node", piece).select("key", "__i", "__j", "node"))
    asked = checkpointed(nodes.select("node", "least").join(cells.select("node").distinct(), "node"))
    bitmap = np.zeros(_WORDS, "u8")
    at = F.xxhash64("least")
    for r in asked.select(at.alias("h")).groupBy(F.expr(f"pmod(h, {_WORDS})").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(shiftright(h, 16), 64) as int)))").alias("b")).collect():
        bitmap[r.w] = r.b & (2**64 - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            h = part.column(2).to_numpy()
            part = part.filter(pa.array((bitmap[h % _WORDS] >> ((h >> 16) % 64).astype("u8") & np.uint64(1)).astype(bool)))
            sets = [shingle_set(t, shingle).tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.binary())], names=["least", "hashes"])

    rank = docs.schema["__rank"].dataType.simpleString()
    rows = docs.select(texts_or_empty("__text").alias("__text"), "__rank", F.xxhash64("__rank").alias("h")).mapInArrow(read, f"least {rank}, hashes binary")
    sets = rows.join(asked, "least").select("node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, bounds in whole_runs(batches, 3):
            node, us, vs = own.column(3).to_numpy(), [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1:
                    roots = similar_roots([np.frombuffer(x, "<u8") for x in own.column(4).slice(a, b - a).to_pylist()], threshold)
                    moved = np.flatnonzero(roots != np.arange(b - a))
                    us.append(node[a:b][moved])
                    vs.append(node[a:b][roots[moved]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    keys = ["key", "__i", "__j"]
    return cells.join(sets, "node").select(*keys, "node", "hashes").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def drop_similar(
    docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, radius: int = RADIUS, segments: int = SEGMENTS, bands: int = BANDS
) -> DataFrame:
    """One row of each group of texts that pairs of at least ``threshold`` join, with all columns: the one of the smallest id.

    Null and wordless texts are one group. Nulls rank last among ids; of repeated
    rows of one id the one of the smallest text hash stays. With ``bands`` zero only
    pairs that fingerprints join are compared.
    """
    rows = ranked_rows(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            sets = [shingle_set(t, shingle) for t in part.column(0).to_pylist()]
            node = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64())
            fp = pa.array([set_fingerprint(s) if can_link(len(s), threshold) else None for s in sets], pa.int64())
            keys = pa.array([band_keys(s, bands) if can_link(len(s), threshold) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(1), node, fp, keys], names=["rank", "node", "fp", "keys"])

    rank = rows.schema["__rank"].dataType.simpleString()
    found = rows.select(texts_or_empty("__text").alias("__text"), "__rank").mapInArrow(run, f"rank {rank}, node long, fp long, keys array<long>")
    nodes = checkpointed(found.groupBy("node").agg(F.min("rank").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    joined = connected_components(similar_links(rows, nodes, fingerprint_groups(nodes, radius, segments), shingle, threshold, block))
    keyed = nodes.join(joined, "node", "left").select(F.explode("keys").alias("key"), "node", F.coalesce("component", "node").alias("piece"))
    more = similar_links(rows, nodes, keyed, shingle, threshold, block)
    of = connected_components(joined.toDF("u", "v").union(more)).withColumnRenamed("node", "of")
    kept = nodes.join(of, nodes.node == of.of, "left").select("least", F.coalesce("component", "node").alias("c")).groupBy("c").agg(F.min("least").alias("least"))
    return first_rows(rows, kept, docs.columns)
