"""The analysis as a stream: a page is one row, so no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import PostprocessOptions
from ..plans.layout import analyze_packed

PACKED = "page_id BIGINT, width INT, height INT, columns INT, values ARRAY<FLOAT>"


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Packed pages as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(PACKED).parquet(path)


def analyze_stream(pages: DataFrame, output: str, checkpoint: str, options: PostprocessOptions = PostprocessOptions(), **trigger: object) -> StreamingQuery:
    """Write result pages as Parquet, each page exactly once."""
    out = analyze_packed(pages, options).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
