"""Detections derived from the ``events`` table: one page for each user, one row for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HASH = "((event_id * 2654435761) % 4294967296)"
#: (column, expression, type) with h for the hash; coordinates are small whole numbers.
_COLUMNS = (
    ("page_id", "user_id", "BIGINT"),
    ("row_index", "event_id", "BIGINT"),
    ("class_value", "CASE WHEN (h div 3) % 10 = 0 THEN 18 WHEN (h div 3) % 10 <= 4 THEN 22 WHEN (h div 3) % 10 = 5 THEN 19 WHEN (h div 3) % 10 = 6 THEN 21 ELSE (h div 11) % 27 - 1 END", "FLOAT"),
    ("score", "CAST((h div 13) % 1000 AS FLOAT) / CAST(1000 AS FLOAT)", "FLOAT"),
    ("x1", "((h div 7) % 6) * 180 - 40", "FLOAT"),
    ("y1", "((h div 97) % 9) * 160 - 40", "FLOAT"),
    ("x2", "((h div 7) % 6) * 180 - 40 + 170 + ((h div 193) % 4) * 10", "FLOAT"),
    ("y2", "((h div 97) % 9) * 160 - 40 + 100 + ((h div 389) % 12) * 20", "FLOAT"),
    ("order_value", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE (h div 769) % 40 END", "FLOAT"),
    ("width", "1000 + (user_id % 3) * 100", "INT"),
    ("height", "1400", "INT"),
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded detection rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.expr(_HASH).alias("h"))
    return events.select(*(F.expr(f"CAST({e} AS {t})").alias(c) for c, e, t in _COLUMNS))


def detections_sql() -> str:
    """The same rows in DuckDB SQL."""
    own = ", ".join(f"CAST({e.replace(' div ', ' // ')} AS {t}) AS {c}" for c, e, t in _COLUMNS)
    return f"SELECT {own} FROM (SELECT event_id, user_id, {_HASH} AS h FROM events)"


def packed(rows: DataFrame) -> DataFrame:
    """Packed pages ``(page_id, width, height, columns, values)``: rows in order of their index."""
    six = [F.col(c) for c in ("class_value", "score", "x1", "y1", "x2", "y2")]
    wide = F.col("order_value").isNotNull()
    row = F.struct("row_index", F.when(wide, F.array(*six, F.col("order_value"))).otherwise(F.array(*six)).alias("v"))
    pages = rows.groupBy("page_id", "width", "height").agg(F.sort_array(F.collect_list(row)).alias("r"), F.max(wide).alias("w"))
    return pages.select("page_id", "width", "height", F.when(F.col("w"), 7).otherwise(6).alias("columns"), F.flatten(F.transform("r", lambda x: x["v"])).alias("values"))
