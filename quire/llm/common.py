"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stand-in for a null identifier when rows are ranked: null ranks last.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; choose one only if none is named.

    Local mode falls back to a temporary folder, a cluster to its warehouse,
    which all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="quire-checkpoint-")
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint-{uuid.uuid4().hex}"
    sc.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so that lost executors cost no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices that are cheap to hold as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
