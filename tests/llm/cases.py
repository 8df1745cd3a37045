"""Awkward rows that every operator must take, and helpers."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 4000


def awkward(spark, extra=()):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids; more rows may be added."""
    rows = [
        (1, "a b c d e f", "en", "s", 11),
        (1, "a b c d e f", "en", "s", 11),
        (1, "another text of the same id", "en", "s", 27),
        (2, None, "en", "s", None),
        (3, "", None, None, 0),
        (None, "a text without an id", "en", "s", 20),
        (None, "a text without an id", "en", "s", 20),
        (None, None, None, None, None),
        (4, "   \n\t ", "en", "s", 6),
        (5, LONG, "en", "s", len(LONG)),
        (6, "x" * 30_000 + "1" * 3000 + "@" * 300, "en", "s", 33_300),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(frame):
    """Extra columns with names that operators use inside or give."""
    from pyspark.sql import functions as F

    names = ["fp", "rank", "key", "pos", "n", "node", "u", "v", "label", "score", "predicted", "held_out", "piece", "tokens", "__fp", "__text", "found", "length", "start", "id", "least", "component_id", "removed_spans"]
    return frame.select("*", *(F.lit("clash").alias(x) for x in names if x not in frame.columns))


def listed(frame):
    return sorted(map(str, frame.collect()))
