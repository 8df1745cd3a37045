"""Bounded-space online best-fit packing of token sequences.

Two passes. The first turns every document into pieces of at most ``capacity``
tokens, without a shuffle, and keeps a small row for each piece. The second
deals those rows over packing tasks and packs each task's stream online, each
piece as it arrives and with no view of later ones: a fixed number of open bins
hang in stacks by their free space, and a bitset marks the non-empty stacks, so
the best fit is the lowest set bit at or above a piece's length. When a new bin
would be one too many, the fullest open bin is closed first. A task holds its
open bins only, whatever the number of rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_slices, texts_or_empty

CAPACITY = 4096
#: Bins that one packing task holds open; the next one closes the fullest.
OPEN_BINS = 256
#: Pieces that one packing task gets.
PIECES_PER_TASK = 50_000
END_ID = 1
#: A chunk of Latin letters, digits and marks up to a letter or digit, then closing marks.
_PLAIN = re.compile(r"([\x21-\x7e\u00a1-\u024f]*[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,;:!?]*)")


class BestFit:
    """Online best-fit over at most ``open_bins`` bins; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.count = 0
        self.made = 0
        self.closed = 0  # before they were full

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} tokens, not {length}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if length < self.capacity and self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.stacks[left]:
                self.bits |= 1 << left
            self.stacks[left].append(at)
            self.count += 1
        return at, self.capacity - free


class WordTokenizer:
    """Ids of a ``tokenizers`` file, packed as unsigned 32-bit little-endian.

    Matches of the file's pre-tokenizer never hold white space, so a text is cut
    at plain spaces and line ends and each distinct chunk is encoded once; the
    table of known chunks is bounded by ``memo``.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}
        self.memo_size = memo

    def _encode(self, unknown: list[str]) -> None:
        """Put chunks into the table: plain ones as lower-case word and closing marks, which are tokens of their own."""
        memo, parts, fresh = self.memo, {}, set()
        for chunk in unknown:
            plain = _PLAIN.fullmatch(chunk)
            own = (plain[1].lower(), plain[2]) if plain and "<|" not in chunk and "\u0130" not in chunk else (chunk,)
            parts[chunk] = own
            fresh.update(x for x in own if x not in memo)
        fresh = list(fresh)
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            for part, x in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                memo[part] = array("I", x.ids).tobytes()
        for chunk, own in parts.items():
            memo[chunk] = memo[own[0]] if len(own) == 1 or not own[1] else memo[own[0]] + memo[own[1]]

    def packed(self, texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        memo = self.memo
        if len(memo) > self.memo_size:
            memo.clear()
            memo[""] = b""
        unknown = list({c for own in chunks for c in own if c not in memo})
        if unknown:
            self._encode(unknown)
        return [b"".join(map(memo.__getitem__, own)) for own in chunks]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return WordTokenizer(path)


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces ``(id, piece, start, length, ids_crc32[, ids])``; only longer documents are cut.

    A null text counts as empty, so that its one piece is the end id alone.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(vocabulary)
        for part in small_slices(batches, 128):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, packed in enumerate(own.packed(part.column(1).to_pylist())):
                packed += end
                n = len(packed) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    x = packed[4 * at : 4 * (at + capacity)]
                    of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(x) // 4)
                    crc.append(zlib.crc32(x))
                    if with_ids:
                        ids.append(np.frombuffer(x, "<u4").astype("i4"))
            columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_column, texts_or_empty(text_column).alias("text")).mapInArrow(run, out)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int = 1, length_column: str = "length", order: list[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a length.

    Rows are dealt by a hash of ``order`` and arrive in the order of that hash,
    which lengths have no part in; a task that runs again makes the same sequences.
    """
    order = order or pieces.columns
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            task = batch.column(len(names) + 1).to_pylist()
            got = [bins.place(n) for n in batch.column(names.index(length_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([t << 40 | b for t, (b, _) in zip(task, got)], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("__order", F.xxhash64(*order)).repartition(tasks, "__order").withColumn("__task", F.spark_partition_id().cast("long"))
    return dealt.sortWithinPartitions("__order", *order).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A row for each piece: ``(id, piece, start, length, ids_crc32, sequence_id,
    offset)``. A null text counts as empty; null ids and repeated rows are packed
    like any other; an empty table gives no rows; other columns are ignored.
    """
    pieces = checkpointed(document_pieces(docs, vocabulary, capacity, end_id, id_column, text_column))
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    return pack_pieces(pieces, capacity, open_bins, tasks, order=[id_column, "piece", "start", "length", "ids_crc32"])
