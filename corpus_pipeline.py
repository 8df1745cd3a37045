"""A corpus pipeline in stages: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; all but the last return the columns of their input, whatever their names,
and an empty table gives an empty one. Needs the subpackage ``quire.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import ensure_checkpoint_dir, remove_folder, table
from quire.llm.jaccard import drop_similar
from quire.llm.packing import pack_documents
from quire.llm.pii import redact_pii
from quire.llm.queries import vocabulary
from quire.llm.substring import without_repeats
from quire.llm.toxicity import keep_civil
from quire.shipping import ship

#: No SQL: tokenizers, fitted models and hashes are not expressible.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; a null or empty text is not, repeated rows share their fate."""
    ship(spark)
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles, by SimHash and an exact check: the one of the smallest id.

    Null, empty and wordless texts are one group; null ids rank last, rows of one id by text and then by all other columns.
    """
    return drop_similar(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; null texts stay null, rows equal in id and text come out alike."""
    return without_repeats(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each piece of personal data or secret replaced by its kind; null texts stay null, no row is dropped."""
    return redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_copies),
    ("substring-dedup", drop_repeats),
    ("pii", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    A stage's table goes once the next one is written, so at most two are held at
    a time; the last one is the result's.
    """
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        place = f"{shared}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if last is not None:
            remove_folder(spark, last)
        last = place
    return docs
