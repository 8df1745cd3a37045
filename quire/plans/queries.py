"""Queries over the derived detections, one for each operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import present
from ..functions.decode import class_id, counts_verdict, order_of, page_verdict
from ..functions.geometry import clamped_box
from ..functions.labels import color_of, label_of, parse_label
from ..operators import blocks as B
from ..operators.detector import FakeDetector, detect
from ..operators.packing import batch_slots, split_batches, unnested
from ..operators.preprocess import preprocess
from ..options import BATCH_SIZE, NMS_IOU, THRESHOLD, LoadOptions, PostprocessOptions, PreprocessOptions
from ..sources.detections import detections, packed
from ..sources.documents import decode_images, file_kind, form_pages, is_pdf, limited, render_pdfs, render_png_pages
from ..sources.png import encode_png
from . import layout
from .bytes_api import analyze_image_bytes, analyze_image_bytes_batch

Query = Callable[[SparkSession, str], DataFrame]
MAX_PAGES = 3
DEFAULTS = PostprocessOptions()
SMALL = PreprocessOptions(80, 60)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decoded(detections(spark, sf_dir), THRESHOLD)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_rows(_decoded(spark, sf_dir))


def page_layout(spark, sf_dir):
    return layout.page_layout(detections(spark, sf_dir))


def score_filter(spark, sf_dir):
    return _decoded(spark, sf_dir).select("page_id", "row_index", "score")


def label_decode(spark, sf_dir):
    rows = detections(spark, sf_dir)
    return rows.select("page_id", "row_index", "class_value", label_of(class_id(F.col("class_value"))).alias("label"))


def label_color(spark, sf_dir):
    rows = detections(spark, sf_dir).select("page_id", "row_index", label_of(class_id(F.col("class_value"))).alias("label"))
    return rows.withColumn("color", color_of(F.col("label")))


def label_parse(spark, sf_dir):
    label = label_of(class_id(F.col("class_value")))
    k = F.col("row_index") % 3
    name = F.when(k == 0, label).when(k == 1, F.lower(label)).otherwise(F.concat(label, F.lit("s")))
    return detections(spark, sf_dir).select("page_id", "row_index", name.alias("name")).withColumn("parsed", parse_label(F.col("name")))


def order_decode(spark, sf_dir):
    return detections(spark, sf_dir).select("page_id", "row_index", order_of(F.col("order_value")).alias("ord"))


def box_clamp(spark, sf_dir):
    box = clamped_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    return detections(spark, sf_dir).select("page_id", "row_index", *(c.alias(n) for n, c in box._asdict().items()))


def _overlaps(spark: SparkSession, sf_dir: str, touching: bool, **columns: Callable) -> DataFrame:
    o = B.pair_overlap()
    return B.pairs(_decoded(spark, sf_dir), touching).select("page_id", "left_row", "right_row", *(f(o).alias(n) for n, f in columns.items()))


def overlap_metrics(spark, sf_dir):
    return _overlaps(spark, sf_dir, False, intersection=lambda o: o.intersection, min_area=lambda o: o.min_area, union_area=lambda o: o.union)


def iou_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, True, iou=lambda o: o.iou).where("iou > 0")


def overlap_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, True, overlap=lambda o: o.score).where(F.col("overlap") > F.lit(NMS_IOU).cast("float"))


def relabel_reference(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", B.relabelled(F.col("blocks"), NMS_IOU).alias("blocks"))
    return pages.select("page_id", F.explode("blocks").alias("s")).select("page_id", "s.row_index", "s.label")


def _suppressed(spark: SparkSession, sf_dir: str, nms: float, cross: float, relabel: bool) -> DataFrame:
    ranked = B.by_score(F.col("blocks"))
    ranked = B.relabelled(ranked, nms) if relabel else ranked
    pages = _pages(spark, sf_dir).select("page_id", B.suppressed(ranked, nms, cross).alias("blocks"))
    return B.exploded(pages).select("page_id", "pos", "row_index", "label", "score")


def nms_same_label(spark, sf_dir):
    return _suppressed(spark, sf_dir, 0.5, 1.0, False)


def nms_cross_label(spark, sf_dir):
    return _suppressed(spark, sf_dir, 1.0, 0.9, False)


def suppress(spark, sf_dir):
    return _suppressed(spark, sf_dir, 0.5, 0.9, True)


def reading_order(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", B.by_reading_order(F.col("blocks")).alias("blocks"))
    return B.exploded(pages).select("page_id", "pos", "row_index", "score", "ord")


def unnest_rows(spark, sf_dir):
    return unnested(packed(detections(spark, sf_dir)), "page_id")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of one width of rows to a batch."""
    pages = packed(detections(spark, sf_dir)).withColumn("batch_id", F.expr("page_id div 4"))
    one = F.struct("page_id", "width", "height", "columns", "values")
    rows = pages.groupBy("columns", "batch_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return rows.select(
        "batch_id", "columns",
        F.flatten(F.transform("p", lambda x: x["values"])).alias("values"),
        F.transform("p", lambda x: (F.size(x["values"]) / x["columns"]).cast("int")).alias("row_counts"),
        F.transform("p", lambda x: F.struct(x["width"].alias("width"), x["height"].alias("height"))).alias("image_sizes"),
    )


def batch_split(spark, sf_dir):
    pages = split_batches(_batches(spark, sf_dir), "batch_id")
    rows = unnested(pages, "batch_id", "image_index", "width", "height")
    return rows.select("batch_id", F.col("image_index").cast("bigint").alias("image_index"), "width", "height", F.when(F.col("order_value").isNull(), 6).otherwise(7).alias("columns"), "row_index", "class_value", "score", "x1", "y1", "x2", "y2", "order_value")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of their user's document, numbered from 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), "event_id")
    return events.withColumn("page_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("event_id")) - 1).cast("bigint"))


def batch_assign(spark, sf_dir):
    batch, slot = batch_slots(F.col("page_index"), BATCH_SIZE)
    return _indexed(spark, sf_dir).select("doc_id", "page_index", batch.alias("batch"), slot.alias("slot"))


def page_limit(spark, sf_dir):
    return limited(_indexed(spark, sf_dir), MAX_PAGES)


def validate_rows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    unit = lambda n: ((F.col("event_id") % n - 1) / 4).cast("float")
    columns, values = F.col("event_id") % 9, F.col("event_id") % 9 * 3 + F.expr("event_id div 9") % 2
    return events.select("event_id", page_verdict(columns, values, unit(7), unit(11), unit(13)).alias("verdict"))


def row_counts_valid(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return events.select("event_id", counts_verdict(F.array(F.col("event_id") % 7, F.col("event_id") % 5 - 1)).alias("verdict"))


def run_totals(spark, sf_dir):
    rows = detections(spark, sf_dir).groupBy((F.col("page_id") % 10).alias("run_id")).agg(F.count("*").alias("rows"), F.countDistinct("page_id").alias("pages"))
    done = _pages(spark, sf_dir).select((F.col("page_id") % 10).alias("run_id"), F.size(B.resolved(F.col("blocks"), DEFAULTS)).cast("bigint").alias("n"))
    blocks = done.groupBy("run_id").agg(F.sum("n").alias("total_blocks"))
    return rows.join(blocks, "run_id", "left").select("run_id", "pages", F.coalesce("total_blocks", F.lit(0).cast("bigint")).alias("total_blocks"), "rows")


def order_rank(spark, sf_dir):
    return _decoded(spark, sf_dir).select("page_id", "row_index", "ord", present.order_rank("page_id", "ord").alias("rank"))


def display_label(spark, sf_dir):
    rows = _decoded(spark, sf_dir).withColumn("rank", present.order_rank("page_id", "ord"))
    return rows.select("page_id", "row_index", present.display_label(F.col("rank"), F.col("label"), F.col("score")).alias("display"))


def draw_plan(spark, sf_dir):
    plan = present.draw_plan(F.col("width"), F.col("x"), F.col("y"))
    return _decoded(spark, sf_dir).select("page_id", "row_index", *(c.alias(n) for n, c in plan.items()))


def progress(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 120 - 10).alias("done"), (F.col("user_id") % 100).alias("total"))
    return events.select("event_id", "done", "total", present.progress_percent(F.col("done"), F.col("total")).alias("percent"))


def elapsed(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") * 37 % 100000).alias("ms"))
    return events.withColumn("elapsed", present.elapsed(F.col("ms")))


def page_caption(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", F.size(B.resolved(F.col("blocks"), DEFAULTS)).alias("n"))
    return pages.select("page_id", present.caption(F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("n")).alias("caption"))


def page_source(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return _indexed(spark, sf_dir).select("doc_id", "page_index", present.page_source(name, F.col("page_index")).alias("source"))


def page_json(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("blocks", B.resolved(F.col("blocks"), DEFAULTS))
    return pages.select("page_id", layout.page_json(F.col("width"), F.col("height"), F.col("blocks")).alias("json"))


def json_roundtrip(spark, sf_dir):
    read = page_json(spark, sf_dir).select("page_id", F.from_json("json", layout.PAGE_JSON).alias("p"))
    rows = read.select("page_id", "p.width", "p.height", F.posexplode("p.blocks").alias("pos", "s"))
    return rows.select("page_id", "width", "height", F.col("pos").cast("bigint").alias("pos"), "s.label", "s.score", F.col("s.bbox.x").alias("x"), F.col("s.bbox.y").alias("y"), F.col("s.bbox.width").alias("w"), F.col("s.bbox.height").alias("h"), F.col("s.order").alias("ord"))


# Endings that make file names of urls without one.
ENDINGS = (".pdf", ".PDF", ".png", ".JPeG", ".webp", "")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 6 + 1).cast("int"))
    return pages.select("page_id", F.concat(F.lit("file"), F.col("page_id").cast("string"), ending).alias("name"))


def pdf_test(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("is_pdf", is_pdf(F.col("name")))


def kind_of_file(spark, sf_dir):
    mime = F.when(F.col("page_id") % 5 == 0, "image/gif").when(F.col("page_id") % 7 == 0, "application/pdf")
    return _names(spark, sf_dir).withColumn("kind", file_kind(F.col("name"), mime))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("page_id", "width", "height").distinct()


def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector gets beside the pixels, of blank pages a hundredth of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, heights = (c.to_pylist() for c in batch.columns)
            rows = [preprocess([np.zeros((h // 100, w // 100, 3), "u1")], SMALL) for w, h in zip(widths, heights)]
            told = np.array([[*b.im_shape[0], *b.scale_factor[0]] for b in rows], "f4").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(told[:, k]) for k in range(4))], names=["page_id", "target_h", "target_w", "scale_h", "scale_w"])

    return _sizes(spark, sf_dir).mapInArrow(run, "page_id long, target_h float, target_w float, scale_h float, scale_w float")


def im_shape(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("page_id", "target_h", "target_w")


def scale_factor(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("page_id", "scale_h", "scale_w")


def _raster(content: bytes, max_pages: int, dpi: float):
    """A stand-in PDF renderer: as many small gray pages as the content has bytes, up to the limit, of a shade that the content gives."""
    shade = sum(content) % 256
    for _ in range(min(len(content), max_pages)):
        yield 8, 6, bytes([shade, shade, shade]) * 48


def load_pages(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.encode(F.col("url"), "UTF-8").alias("content"))
    pages = render_pdfs(files.select(F.col("url").alias("path"), "content"), LoadOptions(MAX_PAGES), _raster)
    return pages.select("path", F.col("page_index").cast("bigint").alias("page_index"), "image.width", "image.height")


def detect_pages(spark, sf_dir):
    """Rendered stand-in pages through tensors, a deterministic detector and the page analysis."""
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.encode(F.col("url"), "UTF-8").alias("content"))
    found = detect(render_pdfs(files, LoadOptions(1), _raster), FakeDetector, SMALL)
    done = layout.analyze_packed(found)
    score = F.round(F.get(F.col("blocks"), 0)["score"].cast("double"), 3)  # of the table: it follows the pixels
    return done.select("path", F.size("blocks").cast("bigint").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["label"]), ",").alias("labels"), score.alias("score"))


def _pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray PNG files as wide as the id says, of a shade that the url gives."""
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = (c.to_pylist() for c in batch.columns)
            made = [encode_png(i % 5 + 1, 2, 1, bytes([sum(p.encode()) % 256]) * (i % 5 + 1) * 2) for i, p in zip(ids, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["page_id", "path", "content"])

    return files.mapInArrow(run, "page_id long, path string, content binary")


def png_pages(spark, sf_dir):
    """PDF pages as PNG files, and what the files hold when they are read again."""
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.encode(F.col("url"), "UTF-8").alias("content"))
    pages = render_png_pages(files, _raster, 1)
    read = decode_images(pages.select("path", F.col("png_data").alias("content")))
    shade = F.conv(F.hex(F.substring(F.col("image.data"), 1, 1)), 16, 10).cast("bigint")
    return read.select("path", F.col("image.width").alias("width"), F.col("image.height").alias("height"), shade.alias("shade"))


def image_form(spark, sf_dir):
    return form_pages(_pngs(spark, sf_dir))


def image_json(spark, sf_dir):
    done = analyze_image_bytes(_pngs(spark, sf_dir), FakeDetector, preprocessing=SMALL)
    read = done.select("path", F.from_json("json", layout.PAGE_JSON).alias("p"))
    score = F.round(F.col("p.blocks")[0]["score"].cast("double"), 3)
    return read.select("path", "p.width", "p.height", F.size("p.blocks").cast("bigint").alias("n_blocks"), score.alias("score"))


def image_json_batch(spark, sf_dir):
    batches = _pngs(spark, sf_dir).groupBy(F.expr("page_id div 4").alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", "content"))).alias("s"))
    done = analyze_image_bytes_batch(batches.select("batch_id", F.col("s.content").alias("images")), FakeDetector, preprocessing=SMALL)
    read = done.select("batch_id", F.from_json("json", f"ARRAY<{layout.PAGE_JSON}>").alias("p"))
    return read.select("batch_id", F.array_join(F.col("p.width").cast("array<string>"), ",").alias("widths"))


def queries() -> dict[str, Query]:
    own = (
        page_layout, score_filter, label_decode, label_color, label_parse, order_decode, box_clamp, overlap_metrics, iou_pairs,
        overlap_pairs, relabel_reference, nms_same_label, nms_cross_label, suppress, reading_order, unnest_rows, batch_split,
        batch_assign, page_limit, validate_rows, row_counts_valid, run_totals, order_rank, display_label, draw_plan, progress,
        elapsed, page_caption, page_source, page_json, json_roundtrip, im_shape, scale_factor, load_pages, detect_pages,
        png_pages, image_form, image_json, image_json_batch,
    )
    return {f.__name__: f for f in own} | {"is_pdf": pdf_test, "file_kind": kind_of_file}


