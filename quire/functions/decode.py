"""Decoding of detector values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG, MIN_LONG = 2**63 - 1, -(2**63)


def to_long(value: Column) -> Column:
    """A float truncated toward zero; NaN gives 0, what does not fit the nearest long."""
    edge = F.when(value > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG))
    return F.when(F.isnan(value), F.lit(0).cast("bigint")).otherwise(F.coalesce(value.try_cast("bigint"), edge))


def class_id(value: Column) -> Column:
    """Class of a raw value; negative ones are class 0."""
    return F.when((value < 0) | F.isnan(value), F.lit(0).cast("bigint")).otherwise(to_long(value))


def order_of(value: Column) -> Column:
    """Reading order of a raw value; null without one."""
    return F.when(value.isNotNull(), to_long(value))


def keeps_score(score: Column, threshold: float) -> Column:
    """Not below the threshold as a float; NaN is kept."""
    return ~(score < F.lit(threshold).cast("float"))


def _outside(value: Column) -> Column:
    return F.isnan(value) | (value < 0) | (value > 1)


def page_verdict(columns: Column, values: Column, threshold: Column, nms: Column, cross: Column) -> Column:
    """The first fault of a page's packed rows, or null; ``values`` is their number."""
    divisor = F.when(columns < 1, 1).otherwise(columns)
    return (
        F.when(columns < 6, "fetch rows must contain at least 6 columns")
        .when(values % divisor != 0, "fetch row value count must be divisible by columns")
        .when(_outside(threshold), "threshold must be between 0 and 1")
        .when(_outside(nms), "nms_iou_threshold must be between 0 and 1")
        .when(_outside(cross), "cross_label_iou_threshold must be between 0 and 1")
    )


def batch_verdict(images: Column, counts: Column, columns: Column, values: Column) -> Column:
    """The first fault of a batch, or null; ``counts`` is an array of row counts."""
    divisor = F.when(columns < 1, 1).otherwise(columns)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n)
    return (
        F.when(F.size(counts) != images, "batch row counts must match image count")
        .when((columns == 0) | (values % divisor != 0), "batched fetch row value count must be divisible by columns")
        .when(total * columns != values, "batch row counts must sum to fetch row count")
    )


def counts_verdict(counts: Column) -> Column:
    """The fault of a detector's row counts, or null."""
    return F.when(F.exists(counts, lambda n: n < 0), "model output contains an invalid row count")
