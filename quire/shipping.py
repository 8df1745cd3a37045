"""Send this package to Python workers that cannot import it on their own."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless the workers' path already leads to it.

    The driver's file server hands the archive to the executors; no shared folder is needed.
    """
    sc = spark.sparkContext
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _sent or str(_ROOT) in inherited:
        return
    archive = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((_ROOT / "quire").rglob("*.py")):
            z.write(path, path.relative_to(_ROOT))
        for path in _ROOT.glob("*.py"):
            z.write(path, path.name)
    sc.addPyFile(str(archive))
    _sent.add(sc.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package sent first; the session is its first argument."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest: object) -> DataFrame:
        ship(spark)
        return query(spark, *rest)

    return run
