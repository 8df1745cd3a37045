"""Exact substring dedup by hashing lines, sentences and windows of words.

A text is cut into units at line ends and, inside lines, after sentence ends. A
unit is normalised (lower case, single spaces) and hashed to 96 bits. Of equal
units the occurrence of the lowest rank (id, text hash, position) stays. Later
occurrences are repeats; a run of adjacent repeated words that has at least
``min_words`` words goes, with its offsets in the original text retained.

Passages that start or end inside sentences are found by windows of ``SIZE``
words, grouped with the units. Winnowing picks them by their
content: of each ``PICK`` windows in a row the one of the lowest hash. So equal
passages of ``SIZE + PICK - 1`` words have an equal window, and at most
``PICK - 1`` words at each end lie outside the windows picked.

Inside a task only the first occurrence of each digest in a bounded chunk of
units enters the global grouping; the others are known repeats already. So a
digest that a third of all rows share meets the shuffle once per chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import NULL_ID, small_slices

#: A run of repeated words goes from this length on; 1 removes every repeat.
MIN_WORDS = 12
#: Words of a window, and windows of which one is picked.
SIZE = 12
PICK = 8
CHUNK_UNITS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(r"\n|(?<=[.!?])\s")


def unit_bounds(text: str) -> list[int]:
    """Ends of the units of a text: after each line end, and after each white space behind a sentence end."""
    ends = [m.end() for m in _CUT.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def unit_words(text: str) -> tuple[list[int], list[str], list[int]]:
    """Ends, normalised forms and word counts of all units; a unit without words is empty."""
    ends, forms, counts, at = unit_bounds(text), [], [], 0
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: normalise unit by unit
        low = None
    for end in ends:
        words = low[at:end].split() if low is not None else text[at:end].lower().split()
        forms.append(" ".join(words))
        counts.append(len(words))
        at = end
    return ends, forms, counts


def windows(text: str, size: int = SIZE) -> tuple[list[int], list[bytes]]:
    """First words and digests of the windows of ``size`` words that winnowing picks."""
    words = text.lower().split()
    n = len(words) - size + 1
    if n < 1:
        return [], []
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    h = np.zeros(n, "u8")
    for k in range(size):
        h = h * _MIX + own[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    width = min(PICK, n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(1) + np.arange(n - width + 1)).tolist()
    raw = own.tobytes()
    return at, [xxhash.xxh3_128_digest(raw[8 * i : 8 * (i + size)], 1) for i in at]


def cut_repeats(text: str, repeats: Iterable[int], min_words: int = MIN_WORDS, starts: Iterable[int] = (), size: int = SIZE) -> tuple[str, list[tuple[int, int]]]:
    """The text without long runs of repeated words, and the spans removed.

    ``repeats`` are units, ``starts`` the first words of windows. Beside a run of
    whole units, windows count from ``min_words`` more words on: a shorter piece of
    the next sentence stays. Where a window overlaps its own first occurrence, the
    latter stays whole.
    """
    ends, _, counts = unit_words(text)
    spots = [m.span() for m in re.finditer(r"\S+", text)]
    whole, gone = np.zeros((2, len(spots)), bool)
    first = np.concatenate([[0], np.cumsum(counts)]).tolist()  # words before each unit
    heads, tails = {}, {}  # of repeated units: where they start and end, by first and last word
    for k in set(repeats):
        if counts[k]:
            whole[first[k] : first[k + 1]] = True
            heads[first[k]], tails[first[k + 1]] = ends[k - 1] if k else 0, ends[k]

    def runs(x: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], x.view("i1"), [0]]))).tolist()
        return [(i, j) for i, j in zip(edges[::2], edges[1::2]) if j - i >= min_words]

    marked = set(starts)
    words = text.lower().split() if marked else []
    for p in marked:
        a = next((q + size for q in range(max(0, p - size + 1), p) if q not in marked and words[q] == words[p] and words[q : q + size] == words[p : p + size]), p)
        gone[a : p + size] = True
    long = np.zeros(len(spots), bool)
    for i, j in runs(whole):
        long[i:j] = True
    for i, j in runs((gone | whole) & ~long):
        long[i:j] = True
    spans = [(heads.get(i, spots[i][0]), tails.get(j, min(len(text), spots[j - 1][1] + 1))) for i, j in runs(long)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    return "".join(kept), spans


def repeated_units(docs: DataFrame, chunk_units: int = CHUNK_UNITS, size: int = SIZE) -> DataFrame:
    """``(rank, key, pos)`` of every unit or window that has an earlier equal one; input columns ``rank, key, text``.

    Windows are numbered by their first word, after the units of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            digest = np.frombuffer(b"".join(p[0] for p in parts), "<u8").reshape(-1, 2)
            h1, h2 = digest[:, 0].view("i8"), (digest[:, 1] & 0xFFFFFFFF).astype("u4").view("i4")
            sizes = [len(p[3]) for p in parts]
            rank = np.repeat(np.array([p[1] for p in parts], "i8"), sizes)
            key = np.repeat(np.array([p[2] for p in parts], "i8"), sizes)
            pos = np.concatenate([p[3] for p in parts]).astype("i4")
            order = np.lexsort((pos, key, rank, h2, h1))
            differs = lambda *columns: np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)]
            fresh, again = np.zeros((2, len(order)), bool)
            fresh[order] = differs(h1, h2, rank, key, pos)  # a repeated row is the same occurrence
            first = differs(h1, h2)
            same = fresh[order] & ~first
            again[order] = same
            # in the order of the rows: neighbours of one document pack well in the shuffle
            h1, h2, rank, key, pos, again = (x[fresh] for x in (h1, h2, rank, key, pos, again))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, rank, key, pos, again)], names=["h1", "h2", "rank", "key", "pos", "again"])

        for batch in small_slices(batches):
            for rank, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                _, forms, counts = unit_words(text)
                pos = [i for i, n in enumerate(counts) if n]
                if pos:
                    at, digests = windows(text, size)
                    digests = [xxhash.xxh3_128_digest(forms[i]) for i in pos] + digests
                    pos += [len(forms) + i for i in at]
                    parts.append((b"".join(digests), rank, key, np.array(pos, "i4")))
                    held += len(pos)
                if held >= chunk_units:
                    yield chunk()
                    parts, held = [], 0
        if parts:
            yield chunk()

    units = docs.where("text is not null").select("rank", "key", "text").mapInArrow(run, "h1 long, h2 int, rank long, key long, pos int, again boolean")
    # known repeats need no grouping: they get a group of their own
    own = F.xxhash64("rank", "key", "pos")
    dealt = units.select(F.when(F.col("again"), own).otherwise(F.col("h1")).alias("h1"), F.when(F.col("again"), F.lit(None).cast("int")).otherwise(F.col("h2")).alias("h2"), "rank", "key", "pos", "again")
    first = Window.partitionBy("h1", "h2").orderBy("rank", "key", "pos")
    return dealt.withColumn("__n", F.dense_rank().over(first)).where("again or __n > 1").select("rank", "key", "pos")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with cut texts, and ``removed_spans`` and ``removed_chars``.

    ``removed_spans`` lists ``start:end`` in code points of the original text,
    comma-joined and in order (empty: nothing removed). Rows are ranked by id (null
    last, and any that is no whole number), then by text hash: rows equal in both
    are one document and come out alike. A null text stays null. No row is dropped, not even one whose text
    becomes empty. Existing columns of the two new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("removed_spans", "removed_chars")]
    row = docs.select(F.struct(*names).alias("__row"), F.coalesce(F.col(id_column).try_cast("long"), F.lit(NULL_ID)).alias("rank"), F.xxhash64(F.col(text_column)).alias("key"), F.col(text_column).cast("string").alias("text"))
    cut = repeated_units(row).groupBy("rank", "key").agg(F.collect_set("pos").alias("__pos"))
    joined = row.join(cut, ["rank", "key"], "left").select(*(F.col(f"__row.`{c}`").alias(c) for c in names), F.col("__pos"))
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            texts, spans, chars = [], [], []
            for text, pos in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                gone: list[tuple[int, int]] = []
                if text is not None and pos:
                    units = len(unit_bounds(text))
                    text, gone = cut_repeats(text, [k for k in pos if k < units], min_words, [k - units for k in pos if k >= units])
                texts.append(text)
                spans.append(",".join(f"{a}:{b}" for a, b in gone))
                chars.append(sum(b - a for a, b in gone))
            columns = part.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string()), pa.array(chars, pa.int64())], names=[*names, "removed_spans", "removed_chars"])

    schema = StructType([*(StructField(c, StringType()) if c == text_column else docs.schema[c] for c in names), StructField("removed_spans", StringType()), StructField("removed_chars", LongType())])
    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with cut texts, all other columns as they are whatever their names."""
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(id_column), F.col(text_column), *([F.struct(*others).alias("__others")] if others else []))
    cut = remove_repeats(rows, min_words, id_column, text_column)
    return cut.select(*(F.col(c) if c in (id_column, text_column) else F.col(f"__others.`{c}`").alias(c) for c in docs.columns))
