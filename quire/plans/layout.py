"""The whole analysis after the detector, and its JSON forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import as_block, decoded, exploded, page_rows, resolved
from ..operators.packing import FIELDS, chunks
from ..functions.decode import class_id, keeps_score, order_of, page_verdict
from ..functions.geometry import clamped_box
from ..functions.labels import label_of
from ..options import PostprocessOptions

BLOCK_JSON = "STRUCT<label: STRING, score: FLOAT, bbox: STRUCT<x: FLOAT, y: FLOAT, width: FLOAT, height: FLOAT>, `order`: BIGINT>"
PAGE_JSON = f"STRUCT<width: INT, height: INT, blocks: ARRAY<{BLOCK_JSON}>>"


def page_layout(rows: DataFrame, options: PostprocessOptions = PostprocessOptions()) -> DataFrame:
    """Result blocks of exploded detections: one shuffle that gathers pages, then expressions."""
    options.check()
    pages = page_rows(decoded(rows, options.threshold))
    return exploded(pages.select("page_id", resolved(F.col("blocks"), options).alias("blocks")))


def packed_blocks(options: PostprocessOptions) -> Column:
    """Blocks of a packed page row ``(width, height, columns, values)``; a contradictory page is an error."""
    options.check()
    unit = [F.lit(float(v)) for v in (options.threshold, options.nms_iou_threshold, options.cross_label_iou_threshold)]
    fault = page_verdict(F.col("columns"), F.size("values"), *unit)
    values = F.when(fault.isNotNull(), F.raise_error(fault).cast("array<float>")).otherwise(F.col("values"))
    rows = chunks(values, F.col("columns"))
    indexed = F.transform(rows, lambda r, i: F.struct(i.cast("bigint").alias("i"), r.alias("r")))
    kept = F.filter(indexed, lambda s: keeps_score(F.get(s["r"], 1), options.threshold))

    def block(s: Column) -> Column:
        raw = {f: F.get(s["r"], k) for k, f in enumerate(FIELDS)}
        order = F.when(F.col("columns") >= 7, raw["order_value"])
        box = clamped_box(raw["x1"], raw["y1"], raw["x2"], raw["y2"], F.col("width"), F.col("height"))
        return as_block({"row_index": s["i"], "label": label_of(class_id(raw["class_value"])), "score": raw["score"], **box._asdict(), "ord": order_of(order)})

    return F.transform(kept, block)


def analyze_packed(pages: DataFrame, options: PostprocessOptions = PostprocessOptions()) -> DataFrame:
    """Result pages of packed pages: all other columns, and ``blocks``. No shuffle; works in streams."""
    names = [c for c in pages.columns if c not in ("columns", "values")]
    return pages.withColumn("__b", packed_blocks(options)).select(*names, resolved(F.col("__b"), options).alias("blocks"))


def result_blocks(blocks: Column) -> Column:
    """Blocks in the shape of the JSON output."""
    return F.transform(blocks, lambda b: F.struct(b["label"].alias("label"), b["score"].alias("score"), F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("width"), b["h"].alias("height")).alias("bbox"), b["ord"].alias("order")))


def page_json(width: Column, height: Column, blocks: Column, page_index: Column | None = None) -> Column:
    """Compact JSON of a page; a missing order is written as null."""
    index = [page_index.alias("page_index")] if page_index is not None else []
    return F.to_json(F.struct(*index, width.alias("width"), height.alias("height"), result_blocks(blocks).alias("blocks")), {"ignoreNullFields": "false"})


def document_json(pages: DataFrame) -> str:
    """Pretty JSON of one document's pages ``(page_index, width, height, blocks)``, made on the driver."""
    rows = pages.orderBy("page_index").select(page_json(F.col("width"), F.col("height"), F.col("blocks"), F.col("page_index")).alias("j")).collect()
    return json.dumps({"pages": [json.loads(r.j) for r in rows]}, indent=2)


def write_json(pages: DataFrame, path: str) -> None:
    """One JSON object for each page, in files."""
    pages.select(page_json(F.col("width"), F.col("height"), F.col("blocks"), F.col("page_index")).alias("value")).write.text(path)
