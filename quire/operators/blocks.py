"""Detections to blocks: decoding, relabelling, suppression, reading order.

A page is one row with an array of block structs, so that all steps after the
detector are Column expressions over that row: no shuffle, and the same plan in
batch and in streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import MAX_LONG, class_id, keeps_score, order_of
from ..functions.geometry import Box, Overlap, clamped_box, computed, edges, f32, let, overlap, overlap_of, shared_sides, touches
from ..functions.labels import label_of
from ..options import PostprocessOptions

BLOCK_FIELDS = ("row_index", "label", "score", "x", "y", "w", "h", "ord")


def decoded(rows: DataFrame, threshold: float) -> DataFrame:
    """Exploded detections that pass the score filter, as typed blocks.

    In: ``page_id, row_index, class_value, score, x1, y1, x2, y2, order_value,
    width, height``. The filter stands before the projection, so it reaches the scan.
    """
    kept = rows.where(keeps_score(F.col("score"), threshold))
    box = clamped_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    fields = {"row_index": F.col("row_index"), "label": label_of(class_id(F.col("class_value"))), "score": F.col("score"), **box._asdict(), "ord": order_of(F.col("order_value"))}
    return computed(kept, ["page_id"], fields | {"width": F.col("width"), "height": F.col("height")})


def as_block(columns: dict[str, Column]) -> Column:
    """A block struct with its edges."""
    box = Box(*(columns[c] for c in ("x", "y", "w", "h")))
    return F.struct(*(columns[c].alias(c) for c in BLOCK_FIELDS), *(c.alias(n) for n, c in edges(box).items()))


def page_rows(blocks: DataFrame) -> DataFrame:
    """One row for each page with its blocks; a page without blocks needs a left join to its list of pages."""
    return blocks.groupBy("page_id", "width", "height").agg(F.collect_list(as_block({c: F.col(c) for c in BLOCK_FIELDS})).alias("blocks"))


def by_score(blocks: Column) -> Column:
    """Highest score first (NaN above all), then row index."""
    keyed = F.transform(blocks, lambda b: F.struct(b["score"].alias("k"), F.bitwise_not(b["row_index"]).alias("i"), b.alias("b")))
    return F.transform(F.sort_array(keyed, asc=False), lambda s: s["b"])


def by_reading_order(blocks: Column, ranked: bool = False) -> Column:
    """Lowest order first, blocks without one last; ties by score, then row index (the order of ``ranked`` blocks)."""
    keyed = F.transform(blocks if ranked else by_score(blocks), lambda b, i: F.struct(F.coalesce(b["ord"], F.lit(MAX_LONG)).alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.sort_array(keyed), lambda s: s["b"])


def relabelled(blocks: Column, nms: float) -> Column:
    """Text that overlaps any Reference becomes ReferenceContent."""

    def with_references(own: Column, references: Column) -> Column:
        inside = lambda b: F.exists(references, lambda k: touches(k, b) & overlap(k, b).score_above(f32(nms)))
        return F.transform(own, lambda b: F.when((b["label"] == "Text") & inside(b), b.withField("label", F.lit("ReferenceContent"))).otherwise(b))

    return let(blocks, lambda own: let(F.filter(own, lambda b: b["label"] == "Reference"), lambda references: with_references(own, references)))


def suppressed(ranked: Column, nms: float, cross: float) -> Column:
    """Greedy suppression of blocks in rank order: one that duplicates an earlier kept one goes.

    Dropped blocks drop nothing themselves, so this is a fold, not an anti-join.
    Most pairs of a page are apart: four comparisons settle them.
    """

    def repeats(kept: Column, block: Column) -> Column:
        o = overlap(kept, block)
        same = kept["label"] == block["label"]
        return touches(kept, block) & F.when(same, o.score_above(f32(nms))).otherwise(o.iou > f32(cross))

    def fold(own: Column) -> Column:
        return F.aggregate(own, F.slice(own, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: repeats(k, b)), kept).otherwise(F.concat(kept, F.array(b))))

    return let(ranked, fold)


def resolved(blocks: Column, options: PostprocessOptions) -> Column:
    """Relabelled, suppressed blocks of a page in reading order."""
    options.check()
    ranked = relabelled(by_score(blocks), options.nms_iou_threshold)
    return by_reading_order(suppressed(ranked, options.nms_iou_threshold, options.cross_label_iou_threshold), ranked=True)


def exploded(pages: DataFrame, column: str = "blocks", with_pos: bool = True) -> DataFrame:
    """Block rows of page rows, with their position."""
    rows = pages.select("page_id", F.posexplode(column).alias("pos", "s"))
    fields = [F.col(f"s.{c}").alias(c) for c in BLOCK_FIELDS]
    return rows.select("page_id", *([F.col("pos").cast("bigint").alias("pos")] if with_pos else []), *fields)


def pairs(blocks: DataFrame, touching: bool = False) -> DataFrame:
    """Pairs of blocks of a page, the lower row index first: ``page_id, left_row, right_row`` and the sides of :func:`pair_overlap`.

    ``touching`` leaves only pairs that may share area, told by the join itself.
    """
    own = computed(blocks, ["page_id", "row_index"], edges(Box(*(F.col(c) for c in ("x", "y", "w", "h")))))
    names = own.columns[2:]
    side = lambda s, row: own.select("page_id", F.col("row_index").alias(row), *(F.col(n).alias(f"{s}_{n}") for n in names))
    a, b = ({n: F.col(f"{s}_{n}") for n in names} for s in "ab")
    joined = side("a", "left_row").join(side("b", "right_row"), "page_id").where("left_row < right_row")
    w, h = shared_sides(a, b)
    return computed(joined.where(touches(a, b)) if touching else joined, ["page_id", "left_row", "right_row"], {"__w": w, "__h": h, "__a": a["area"], "__b": b["area"]})


def pair_overlap() -> Overlap:
    """The overlap of a row of :func:`pairs`."""
    return overlap_of(*(F.col(c) for c in ("__w", "__h", "__a", "__b")))
