"""Packed detector output: flat value arrays to rows, batches to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import batch_verdict
from ..functions.geometry import let

FIELDS = ("class_value", "score", "x1", "y1", "x2", "y2", "order_value")


def chunks(values: Column, columns: Column) -> Column:
    """Rows of a flat row-major array."""
    n = (F.size(values) / columns).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(values, i * columns + 1, columns))


def fields_of(row: Column, columns: Column) -> list[Column]:
    """The seven named fields; the order field is null in rows of six."""
    return [F.get(row, k).alias(f) if k < 6 else F.when(columns >= 7, F.get(row, k)).alias(f) for k, f in enumerate(FIELDS)]


def unnested(pages: DataFrame, *keep: str) -> DataFrame:
    """Detection rows of packed pages ``(..., columns, values)`` with ``row_index`` from 0."""
    rows = pages.select(*keep, "columns", F.posexplode(chunks(F.col("values"), F.col("columns"))).alias("row_index", "v"))
    return rows.select(*keep, F.col("row_index").cast("bigint").alias("row_index"), *fields_of(F.col("v"), F.col("columns")))


def split_batches(batches: DataFrame, *keep: str) -> DataFrame:
    """Packed pages of batches ``(..., values, columns, row_counts, image_sizes)``.

    A count of zero gives an empty page. A batch that contradicts itself is an error.
    """
    columns, counts = F.col("columns"), F.col("row_counts")
    fault = batch_verdict(F.size("image_sizes"), counts, columns, F.size("values"))
    state = lambda at, starts: F.struct(at.alias("at"), starts.alias("starts"))
    zero = state(F.lit(0), F.array().cast("array<int>"))
    summed = F.aggregate(counts, zero, lambda s, n: state(s["at"] + n, F.concat(s["starts"], F.array(s["at"]))), lambda s: s["starts"])
    values = lambda at, n: F.slice(F.col("values"), at * columns + 1, n * columns)
    page = lambda starts, n, i: F.struct(i.alias("image_index"), F.get("image_sizes", i)["width"].alias("width"), F.get("image_sizes", i)["height"].alias("height"), values(F.get(starts, i), n).alias("values"))
    pages = let(summed, lambda starts: F.transform(counts, lambda n, i: page(starts, n, i)))
    good = batches.select(*keep, "columns", F.when(fault.isNotNull(), F.raise_error(fault).cast(_pages_type(batches))).otherwise(pages).alias("pages"))
    return good.select(*keep, "columns", F.inline("pages"))


def _pages_type(batches: DataFrame) -> str:
    kind = batches.schema["values"].dataType.simpleString()
    return f"array<struct<image_index:int,width:int,height:int,values:{kind}>>"


def batch_slots(page_index: Column, size: int) -> tuple[Column, Column]:
    """Batch and place in it of a page, in page order."""
    return F.floor(page_index / size).cast("bigint"), (page_index % size).cast("bigint")
