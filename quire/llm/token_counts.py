"""Unigram token counts of whole texts, by dynamic programming over a trie of pre-tokens.

Each distinct pre-token is inserted into a trie that a worker keeps over all its
rows. A node holds the best forward score of the characters above it and the
token count of that best path; both are computed once, when the node is made,
from the nodes above it, however many pre-tokens share the prefix. The count at
a pre-token's last node is its terminal count; a text's count is their sum. The
trie is bounded: past ``max_nodes`` it starts anew, which costs time only.

No public unigram model is at hand, only a BPE vocabulary in order of merges, and
tokenizers are never trained. Scores therefore follow from the order of the file
by Zipf's law: whole numbers, so ties are exact; of equal scores fewer tokens win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_slices, texts_or_empty

#: A byte of a character that no piece covers; below the score of any piece.
BYTE_SCORE = -20_000


def piece_scores(path: str) -> dict[str, int]:
    """Unigram scores of a vocabulary ordered by frequency: Zipf's law, -1000 ln(rank + 1) rounded."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -round(1000 * math.log(rank + 1)) for rank, p in enumerate(pieces, 1)}


class TrieCounter:
    """Token counts of pre-tokens; ``max_nodes`` bounds the trie."""

    def __init__(self, scores: dict[str, int], max_nodes: int = 1_000_000):
        self.scores, self.max_nodes = scores, max_nodes
        self.endings = {p[k:] for p in scores for k in range(len(p))}  # what no longer piece can end with ends a search
        self.clear()

    def clear(self) -> None:
        #: node << 21 | character to node; score and count by node; terminal counts by pre-token
        self.moves: dict[int, int] = {}
        self.best, self.count = [0], [0]
        self.terminals: dict[str, int] = {}
        self.root = self._node("▁", 1, [0])

    def _node(self, text: str, end: int, path: list[int]) -> int:
        """Make the node of ``text[:end]`` below ``path``, the nodes of all its shorter prefixes."""
        best, count, known, endings = self.best, self.count, self.scores.get, self.endings
        size = len(text[end - 1].encode("utf-8", "surrogatepass"))
        above = path[-1]
        top, fewest = best[above] + BYTE_SCORE * size, count[above] + size
        for start in range(end - 1, -1, -1):
            piece = text[start:end]
            score = known(piece)
            if score is not None:
                at = path[start]
                score += best[at]
                if score > top or score == top and count[at] + 1 < fewest:
                    top, fewest = score, count[at] + 1
            elif piece not in endings:
                break
        node = self.moves[above << 21 | ord(text[end - 1])] = len(best)
        best.append(top)
        count.append(fewest)
        return node

    def insert(self, word: str) -> int:
        """The count of a pre-token; only nodes below its longest known prefix are computed."""
        if len(self.best) > self.max_nodes:
            self.clear()
        text, node, path, moves = "▁" + word, self.root, [0, self.root], self.moves.get
        for end in range(2, len(text) + 1):
            node = moves(node << 21 | ord(text[end - 1])) or self._node(text, end, path)
            path.append(node)
        out = self.terminals[word] = self.count[node]
        return out

    def counts(self, text: str) -> tuple[int, int]:
        """``(pre-tokens, tokens)`` of a text."""
        words = text.split()
        known, total = self.terminals.get, 0
        for w in words:
            n = known(w)
            total += self.insert(w) if n is None else n
        return len(words), total


@lru_cache(maxsize=2)
def counter(path: str) -> TrieCounter:
    """One counter for each worker process."""
    return TrieCounter(piece_scores(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_pretokens, n_tokens)`` for each row; pre-tokens are cut at white space.

    A null or empty text has none of either; null ids and repeated rows stay;
    other columns are ignored. There is no shuffle; a worker holds one text and the
    bounded trie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for part in small_slices(batches, 1024):
            got = [own.counts(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=[id_column, "n_pretokens", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, texts_or_empty(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_pretokens long, n_tokens long")
