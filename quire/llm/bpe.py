"""Byte-level BPE as a lazily determinised transducer.

Encoding. For a byte string ``w`` let ``last(i)`` be the final token of the
encoding of ``w[:i]``. Every prefix of an encoding is itself the encoding of
its bytes, so the encoding of ``w`` is read backwards along ``last``, and
``last(i)`` is the only token ``t`` that ends at ``i``, encodes to itself and
stays unmerged next to ``last(i - len(t))``. A transducer state is therefore
the token before a window of undecided bytes plus that window. A boundary is
decided once the chains of all positions at which a longer token could still
start pass through it; the tokens before it are emitted at once. The window is
thus never longer than the longest token. States and transitions are made the
first time they are met and kept in a bounded table.

Decoding. Ids become bytes and run through an incremental UTF-8 state machine
that holds back an unfinished sequence until its next chunk.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_slices, texts_or_empty

#: White space by either of the definitions in use; a chunk that touches one is not cut at a space.
_SPACE = frozenset(chr(c) for c in range(0x110000) if chr(c).isspace()) | {"\x1c", "\x1d", "\x1e", "\x1f", "\x85"}
_TOUCHING = re.compile("^ | $| [{0}]|[{0}] ".format(re.escape("".join(sorted(_SPACE)))))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeTransducer:
    """Encode single pre-tokens; ``max_states`` bounds the lazily built table."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.max_len = max(map(len, ranks), default=1)
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.max_states = max_states
        self._never = len(ranks) + max(ranks.values(), default=0) + 1
        self._own: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.info: list[tuple[tuple[int, bytes], tuple[int, ...]]] = [((-1, b""), ())]
        #: state << 8 | byte to the next state, or to that and what is emitted
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...] | None] = [()]

    def merge_all(self, word: bytes, until: int = 1) -> list[int]:
        """Plain rank-ordered merging, down to ``until`` parts; only for single tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for bytes and unreachable tokens."""
        if rank in self._split:
            return self._split[rank]
        token, found = self.bytes_of[rank], None
        if len(token) > 1:
            parts = self.merge_all(token, until=2)
            if len(parts) == 2 and self.bytes_of[parts[0]] + self.bytes_of[parts[1]] == token:
                found = (parts[0], parts[1])
        self._split[rank] = found
        return found

    def _stays(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses from one token into the next.

        Both tokens' edges at the boundary are followed back in time. The two
        that touch at some moment would merge if their joint rank came before
        what consumes either (of equal ranks the merge further left is first).
        """
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        a, b, a_gone, b_gone, known = left, right, self._never, self._never, True
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < a_gone and joint <= b_gone:
                known = False
                break
            of_a, of_b = self._halves(a), self._halves(b)
            if of_a is not None and (of_b is None or a > b):
                a_gone, a = a, of_a[1]
            elif of_b is not None:
                b_gone, b = b, of_b[0]
            else:
                break
        self._pairs[left, right] = known
        return known

    def _chain(self, lasts: tuple[int, ...] | list[int], end: int) -> list[int]:
        """Boundaries from ``end`` back to the window's start."""
        out = [end]
        while end:
            end -= self.sizes[lasts[end - 1]]
            out.append(end)
        return out

    def _move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        (before, window), lasts = self.info[state]
        window += bytes((byte,))
        n, ranks, own, pairs = len(window), self.ranks, self._own, self._pairs
        for start in range(max(0, n - self.max_len), n):
            rank = ranks.get(window[start:])
            if rank is None:
                continue
            if (known := own.get(rank)) is None:
                known = own[rank] = n - start == 1 or self._halves(rank) is not None
            if known:
                previous = lasts[start - 1] if start else before
                if previous == -1 or (pairs.get((previous, rank)) or self._stays(previous, rank)):
                    lasts = (*lasts, rank)
                    break
        else:
            raise ValueError(f"byte {byte} has no token in this vocabulary")
        spine, decided = self._chain(lasts, n), n
        for start in range(n):
            if window[start:] in self.prefixes:
                if not start:
                    decided = 0
                    break
                at = start
                while at not in spine:
                    at -= self.sizes[lasts[at - 1]]
                if at < decided:
                    decided = at
                    if not at:
                        break
        out: tuple[int, ...] = ()
        if decided:
            out = tuple(lasts[b - 1] for b in reversed(spine) if 0 < b <= decided)
            before, window, lasts = lasts[decided - 1], window[decided:], lasts[decided:]
        if window and window not in self.prefixes:  # no token can start at the window's start any more
            before = -2
        key = (before, window)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.info)
            self.info.append((key, lasts))
            self.ends.append(None)
        step = self.moves[state << 8 | byte] = (to, out) if out else to
        return step

    def _end(self, state: int) -> tuple[int, ...]:
        (_, window), lasts = self.info[state]
        out = self.ends[state] = tuple(lasts[b - 1] for b in reversed(self._chain(lasts, len(window))) if b)
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, emitted from left to right."""
        rank = self.ranks.get(piece)
        if rank is not None:  # a piece that is a token is that token
            return [rank]
        if len(self.info) > self.max_states:
            self._reset()
        out: list[int] = []
        state, known = 0, self.moves.get
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                step = self._move(state, byte)
            if step.__class__ is int:
                state = step
            else:
                state, emitted = step
                out += emitted
        end = self.ends[state]
        out += self._end(state) if end is None else end
        return out


class BpeCodec:
    """Whole texts to ids and back; ``memo`` bounds the table of known chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 250_000, max_states: int = 400_000):
        self.transducer = BpeTransducer(ranks, max_states)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.memo_size = memo
        self.decimal = {r: str(r) for r in self.transducer.bytes_of}

    def _fresh(self, chunk: str) -> bytes:
        encode = self.transducer.encode
        ids = list(chain.from_iterable(encode(p.encode("utf-8", "surrogatepass")) for p in self.find(chunk)))
        return array("I", ids).tobytes()

    def _pieces(self, text: str) -> Iterator[bytes]:
        """Packed ids by chunk: cut before single spaces between non-spaces, where matches always start anew."""
        first, *rest = text.split(" ")
        if _TOUCHING.search(text):  # runs of white space stay whole
            held, spaced = first, []
            for part in rest:
                if held and held[-1] not in _SPACE and part and part[0] not in _SPACE:
                    spaced.append(held)
                    held = part
                else:
                    held += " " + part
            first, *rest = [*spaced, held]
        yield self._fresh(first)
        memo = self.memo
        found = list(map(memo.get, rest))
        if None in found:
            for i, packed in enumerate(found):
                if packed is None:
                    part = rest[i]
                    packed = found[i] = memo.get(part) or self._fresh(" " + part)
                    if len(part) <= 64:
                        memo[part] = packed
        yield from found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, each match of the pattern encoded separately."""
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        return np.frombuffer(b"".join(self._pieces(text)), dtype="<u4")

    def decode(self, ids: Iterable[int], step: int = 8192) -> Iterator[str]:
        """Text in parts; an unfinished UTF-8 sequence waits for its next part."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        bytes_of = self.transducer.bytes_of
        ids = list(ids)
        for at in range(0, len(ids), step):
            yield machine.decode(b"".join(map(bytes_of.__getitem__, ids[at : at + step])))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    """One codec for each worker process."""
    return BpeCodec(load_ranks(path), pattern)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text and the text decoded from them.

    Returns ``(id, ids ARRAY<INT>, decoded STRING)``, a row for each input row.
    A null text counts as empty and gives no ids; a null id is kept; repeated
    rows give repeated rows; other columns are ignored. ``vocabulary`` is a path
    that exists on each executor. No shuffle; memory is bounded by one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for part in small_slices(batches, 64):
            ids = [own.encode(t) for t in part.column(1).to_pylist()]
            decoded = ["".join(own.decode(x.tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[id_column, "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, texts_or_empty(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded string")


def encode_decode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with digests in place of ids and text.

    The digests are taken where the ids are made, so only they leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        dec = own.decimal
        for part in small_slices(batches):
            counts, of_ids, of_text = [], [], []
            for text in part.column(1).to_pylist():
                ids = own.encode(text).tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(dec.__getitem__, ids)).encode()).hexdigest())
                sha = hashlib.sha256()
                for x in own.decode(ids):
                    sha.update(x.encode())
                of_text.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, texts_or_empty(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
