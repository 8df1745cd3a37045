"""Image bytes in, page JSON out: single images, and batches as JSON arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import PreprocessError
from ..operators.detector import TIMES, Detector, detect
from ..options import BATCH_SIZE, CROSS_LABEL_IOU, NMS_IOU, THRESHOLD, PostprocessOptions, PreprocessOptions
from ..sources.decode import Decoder, decode_image
from ..sources.documents import decode_images
from .layout import analyze_packed, page_json


def analyze_image_bytes(
    files: DataFrame,
    detector: Callable[[], Detector],
    threshold: float = THRESHOLD,
    nms_iou_threshold: float = NMS_IOU,
    cross_label_iou_threshold: float = CROSS_LABEL_IOU,
    *,
    preprocessing: PreprocessOptions = PreprocessOptions(),
    batch_size: int = BATCH_SIZE,
    decoder: Decoder = decode_image,
) -> DataFrame:
    """``(path, json)`` of image bytes ``(path, content)``; thresholds are checked before anything is read."""
    options = PostprocessOptions(threshold, nms_iou_threshold, cross_label_iou_threshold).check()
    pages = analyze_packed(detect(decode_images(files, decoder), detector, preprocessing, batch_size), options)
    return pages.select("path", page_json(F.col("width"), F.col("height"), F.col("blocks")).alias("json"))


def analyze_image_bytes_batch(
    batches: DataFrame,
    detector: Callable[[], Detector],
    threshold: float = THRESHOLD,
    nms_iou_threshold: float = NMS_IOU,
    cross_label_iou_threshold: float = CROSS_LABEL_IOU,
    **settings: object,
) -> DataFrame:
    """``(batch_id, json)`` of batches ``(batch_id, images array<binary>)``: a JSON array in the order of the images.

    A ``batch_id`` is one row's; an empty batch is an error. Only JSON is shuffled.
    """
    empty = F.raise_error(F.lit(str(PreprocessError("input image batch must not be empty")))).cast("array<binary>")
    images = F.when(F.coalesce(F.size("images"), F.lit(0)) < 1, empty).otherwise(F.col("images"))
    single = batches.select("batch_id", F.posexplode(images).alias("at", "content"))
    told = single.select(F.to_json(F.struct("batch_id", "at")).alias("path"), "content")
    done = analyze_image_bytes(told, detector, threshold, nms_iou_threshold, cross_label_iou_threshold, **settings)
    kind = batches.schema["batch_id"].dataType.simpleString()
    named = done.select(F.from_json("path", f"batch_id {kind}, at int").alias("k"), "json")
    listed = named.groupBy(F.col("k.batch_id").alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("k.at", "json"))).alias("s"))
    return listed.select("batch_id", F.concat(F.lit("["), F.array_join(F.col("s.json"), ","), F.lit("]")).alias("json"))


def observed(pages: DataFrame, name: str = "layout") -> tuple[DataFrame, Observation]:
    """Analysed pages, and an observation of pages, blocks and stage times that is filled when they are used."""
    seen = Observation(name)
    times = [F.sum(t).alias(t) for t in TIMES if t in pages.columns]
    return pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size("blocks")), F.lit(0)).alias("blocks"), *times), seen
