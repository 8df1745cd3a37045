"""Toxicity scores after noisy-channel deobfuscation.

Text that may be disguised spans a character lattice: a look-alike may stand for
letters; a separator, a space or a repeated letter may be noise; a mark or space
may also be a word break. Viterbi decoding under a character trigram model,
counted over all documents, restores the likeliest words. Decoded are tokens with
marks, digits or thrice repeated letters, whole runs of single letters with their
neighbours, and whatever spells an entry of the lexicon apart from spaces, marks,
look-alikes and repetition: there the entry's own path through the lattice must
come near the best one.

Restored words and their prefixes are scored by a logistic model with weights of
zero or more, learnt from labelled rows. Its ridge penalty falls with a feature's
support, so that rare words of copied passages weigh little.

The scorer is fitted on at most ``MAX_TRAIN`` labelled rows, one for each group
of near copies. Language model and scores cover every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_slices, texts_or_empty

MAX_TRAIN = 20_000
THRESHOLD = 0.3
#: Tokens that a worker's table holds; past that it is emptied.
MEMO = 300_000
#: A feature is learnt if its share of toxic documents reaches LEAST_SHARE when taken this many standard errors low.
ERRORS = 2.0
LEAST_SHARE = 0.3
#: A feature of n toxic documents has the ridge penalty RIDGE / n ** 2.
RIDGE = 20.0
#: Weight from which an entry is looked for in disguise.
HEAVY = 1.0
PREFIXES = (4, 5, 6, 7)
_CLASSES = 28  # 0 boundary, 1-26 a-z, 27 any other letter

#: Characters and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
_EDGES = ".,;:?!\"'`´()[]{}<>|…%&*#~^=/\\-_«»“”„‘’¿¡"
_REPEATED = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
#: Letters of one look-alike count as one where the lexicon is searched.
_ALIKE = str.maketrans({"l": "i", "g": "b", **{c: {"l": "i", "g": "b"}.get(x[0], x[0]) for c, x in LOOKALIKES.items()}})


def _classes() -> np.ndarray:
    out = np.zeros(0x250, "i4")
    for c in range(0x250):
        low = chr(c).lower()
        out[c] = 0 if not low.isalpha() else ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else 27
    return out


_CLASS = _classes()


def _class_of(letter: str) -> int:
    c = ord(letter)
    return int(_CLASS[c]) if c < 0x250 else 27


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of character-class trigrams, with a boundary before and after each text."""
    codes = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], 27)
    return np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others, smoothed towards bigrams and then letters."""
    n = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype("f8")
    one = n.sum((0, 1)) + 1
    one /= one.sum()
    two = n.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def character_model(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """The model over all documents; what is gathered has a row for each trigram of classes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, "i8")
        for part in small_slices(batches):
            total += trigram_counts(part.column(0).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype("i4")), pa.array(total[seen])], names=["code", "n"])

    counts = np.zeros(_CLASSES**3, "i8")
    for r in docs.select(texts_or_empty(text_column)).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    return log_model(counts)


class Channel:
    """Restores text; ``model`` is a table of trigram log probabilities."""

    SUBSTITUTE, NOISE, REPEAT, SPACE = -1.0, -2.5, -0.7, -2.5
    #: How far below the best path a lexicon entry's own path may lie.
    MARGIN = 6.0

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def options(self, ch: str) -> tuple[list[tuple[str, float]], float | None]:
        """The letters (and their cost) that a character may stand for, and its cost as noise; "" is a word break."""
        if ch.isalpha():
            return [(ch, 0.0)], None
        if ch.isspace():
            return [("", 0.0)], self.SPACE
        return [(x, self.SUBSTITUTE) for x in LOOKALIKES.get(ch, "")], self.NOISE

    def best(self, text: str) -> tuple[float, list[str]]:
        """Score and words of the best path through the lattice of a lower-case text (Viterbi over the last two classes)."""
        model = self.model
        beam: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        for ch in text:
            letters, noise = self.options(ch)
            grown: dict[tuple[int, int, str], tuple[float, tuple]] = {}

            def offer(key: tuple[int, int, str], score: float, back: tuple) -> None:
                if key not in grown or score > grown[key][0]:
                    grown[key] = (score, back)

            for (a, b, last), (score, back) in beam.items():
                if noise is not None:
                    offer((a, b, last), score + noise, back)
                for letter, cost in letters:
                    if letter == last:  # a repeated letter, or one more space between words
                        offer((a, b, last), score + cost + (self.REPEAT if letter else 0.0), back)
                        if not letter:
                            continue
                    c = _class_of(letter) if letter else 0
                    offer((b, c, letter), score + cost + model[a][b][c], (back, letter))
            beam = grown
        score, back = max(((s + (model[a][b][0] if b else 0.0), back) for (a, b, _), (s, back) in beam.items()), key=lambda x: x[0], default=(0.0, ()))
        out: list[str] = []
        while back:
            back, letter = back
            out.append(letter or " ")
        return score, "".join(reversed(out)).split()

    def own_path(self, text: str, word: str) -> float:
        """Score of the best path that reads a text as one word; minus infinity without one."""
        a, b, language = 0, 0, 0.0
        for letter in word:
            c = _class_of(letter)
            language += self.model[a][b][c]
            a, b = b, c
        language += self.model[a][b][0]
        costs = [0.0] + [-np.inf] * len(word)  # by letters read so far
        for ch in text:
            letters, noise = self.options(ch)
            of = dict(letters)
            grown = [-np.inf if noise is None else x + noise for x in costs]
            for k, x in enumerate(costs):
                if k and word[k - 1] in of:
                    grown[k] = max(grown[k], x + of[word[k - 1]] + self.REPEAT)
                if k < len(word) and word[k] in of:
                    grown[k + 1] = max(grown[k + 1], x + of[word[k]])
            costs = grown
        return language + costs[-1]

    def reads_as(self, text: str, word: str) -> bool:
        own = self.own_path(text, word)
        return own > -np.inf and own >= self.best(text)[0] - self.MARGIN

    def decode(self, text: str) -> str:
        return " ".join(self.best(text)[1])

    def restore(self, token: str) -> str:
        """The word behind a lower-case token; plain words and numbers are themselves."""
        bare = token.strip(_EDGES)
        if bare.isalpha():
            return bare if not _REPEATED.search(bare) else self.decode(bare)
        return bare if not any(c.isalpha() for c in bare) else self.decode(bare)


def bare_length(token: str) -> int:
    return len(token.strip(_EDGES)) if len(token) > 1 else 1


def spaced_runs(tokens: list[str], singles: list[int] | None = None) -> Iterator[str]:
    """Runs of short tokens that hold two single characters or more, with the tokens beside them."""
    singles = [i for i, t in enumerate(tokens) if bare_length(t) == 1] if singles is None else singles
    at = 0
    while at < len(singles):
        first = last = singles[at]
        at += 1
        while at < len(singles) and all(bare_length(t) < 3 for t in tokens[last + 1 : singles[at]]):
            last = singles[at]
            at += 1
        if last > first:
            yield " ".join(t.strip(_EDGES) or t for t in tokens[max(0, first - 1) : last + 2])


def skeleton(text: str) -> str:
    """What noise leaves alone: letters, look-alikes as one of theirs, without repetition."""
    text = text.translate(_ALIKE)
    if not text.isalpha():
        text = "".join(filter(str.isalpha, text))
    return _RUN.sub(r"\1", text)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def held_out(id_column: str) -> Column:
    """Rows that labels may not be learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


class Restorer:
    """Restored words of texts; ``memo`` bounds the tables of known tokens and runs."""

    def __init__(self, model: np.ndarray, memo: int = MEMO // 3):
        self.channel, self.memo_size = Channel(model), memo
        self.words: dict[str, str] = {}
        self.runs: dict[str, tuple[str, ...]] = {}

    def word(self, token: str) -> str:
        known = self.words.get(token)
        if known is None:
            known = self.channel.restore(token)
            if len(token) <= 64:
                if len(self.words) > self.memo_size:
                    self.words.clear()
                self.words[token] = known
        return known

    def run_words(self, tokens: list[str], singles: list[int] | None = None) -> set[str]:
        """Words that runs of single letters spell."""
        out: set[str] = set()
        for run in spaced_runs(tokens, singles):
            known = self.runs.get(run)
            if known is None:
                known = tuple({w for w in self.channel.best(run)[1] if len(w) > 2})
                if len(run) <= 64:
                    if len(self.runs) > self.memo_size:
                        self.runs.clear()
                    self.runs[run] = known
            out.update(known)
        return out


class Scorer:
    """Scores texts by the weights of features and an intercept."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], intercept: float, memo: int = MEMO):
        self.restorer, self.lexicon, self.intercept, self.memo_size = Restorer(model), lexicon, intercept, memo
        self.index: dict[str, list[str]] = {}
        for w in sorted(lexicon):
            if not w.endswith("*") and self.weight(w) >= HEAVY:
                self.index.setdefault(skeleton(w), []).append(w)
        self.prefixes = {k[:n] for k in self.index for n in range(1, len(k))}
        #: by token: its words that have a weight, its skeleton if an entry could go on behind it, and whether it is one character
        self.memo: dict[str, tuple[dict[str, float], str, bool] | None] = {}

    def weight(self, word: str) -> float:
        known = self.lexicon.get
        out = known(word, 0.0)
        for n in PREFIXES:
            if len(word) <= n:
                break
            out += known(word[:n] + "*", 0.0)
        return out

    def _weighed(self, words: Iterable[str]) -> dict[str, float]:
        return {w: x for w in words if (x := self.weight(w))}

    def _spelled(self, text: str, key: str) -> dict[str, float]:
        """The heaviest entry that a text may spell."""
        own = max(((self.weight(w), w) for w in self.index.get(key, ()) if self.restorer.channel.reads_as(text, w)), default=None)
        return {own[1]: own[0]} if own else {}

    def _look(self, token: str) -> tuple[dict[str, float], str, bool] | None:
        bare = token.strip(_EDGES)
        if bare.isalpha() and not _REPEATED.search(bare):
            words = {bare: x} if (x := self.weight(bare)) else {}
        else:
            words = self._weighed(self.restorer.channel.restore(token).split())
        key = skeleton(bare)
        if not words and key in self.index:
            words = self._spelled(bare, key)
        if not words and len(bare) < len(token) and (token[0] in LOOKALIKES or token[-1] in LOOKALIKES) and (whole := skeleton(token)) in self.index:
            words = self._spelled(token, whole)  # a mark at an edge may be a letter too
        out = words, key if key in self.prefixes else "", bare_length(token) == 1
        return out if any(out) else None

    def words(self, text: str) -> dict[str, float]:
        """The distinct restored words of a text that have a weight."""
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        tokens, memo, long = text.lower().split(), self.memo, []
        for t in set(tokens):
            if t not in memo:
                memo[t] = self._look(t)
                if len(t) > 64:
                    long.append(t)
        told = [(at, found) for at, found in enumerate(map(memo.__getitem__, tokens)) if found]
        for t in long:
            del memo[t]
        out: dict[str, float] = {}
        for at, (words, key, _) in told:
            if words:
                out |= words
            to = at + 1
            while key in self.prefixes and to < len(tokens):  # an entry may go on behind the next space
                key = _RUN.sub(r"\1", key + skeleton(tokens[to].strip(_EDGES)))
                to += 1
                if key in self.index:
                    out |= self._spelled(" ".join(x.strip(_EDGES) or x for x in tokens[at:to]), key)
        singles = [at for at, found in told if found[2]]
        return out | self._weighed(self.restorer.run_words(tokens, singles)) if len(singles) > 1 else out

    def __call__(self, text: str) -> float:
        own = self.words(text)
        return 1.0 / (1.0 + math.exp(-max(-700.0, self.intercept + sum(own[w] for w in sorted(own)))))


def _copy_key(text: str) -> int:
    """The least hash of adjacent word pairs: near copies mostly share it."""
    words = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:])), default=xxhash.xxh3_64_intdigest(" ".join(words))) & (2**63 - 1)


def logistic(rows: list[tuple[bool, list[int], int]], penalty: np.ndarray, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights, none below zero, and intercept of a ridge-penalised logistic model, by accelerated projected gradients.

    ``rows`` are (toxic, features, number of documents).
    """
    y, n = np.array([t for t, _, _ in rows], float), np.array([k for _, _, k in rows], float)
    sizes = np.array([len(f) for _, f, _ in rows], int)
    doc, of = np.repeat(np.arange(len(rows)), sizes), np.array([j for _, f, _ in rows for j in f], int)
    many = len(penalty)
    bend = 0.25 * np.bincount(of, weights=(n * (sizes + 1))[doc], minlength=many) + penalty
    bend0 = 0.25 * float((n * (1 + sizes)).sum()) + 0.05
    w, b, at = np.zeros(many), -2.0, 1.0
    ahead, ahead0 = w, b
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(doc, weights=ahead[of], minlength=len(rows)) + ahead0)))
        off = n * (p - y)
        new = np.maximum(0, ahead - (np.bincount(of, weights=off[doc], minlength=many) + penalty * ahead) / bend)
        new0 = ahead0 - (off.sum() + 0.05 * (ahead0 + 2)) / bend0
        following = (1 + np.sqrt(1 + 4 * at * at)) / 2
        ahead, ahead0 = new + (at - 1) / following * (new - w), new0 + (at - 1) / following * (new0 - b)
        w, b, at = new, float(new0), following
    return w, b


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """The lexicon (weights of features) and the intercept.

    Learns from at most ``max_train`` labelled rows that are not held out, the
    ones of lowest hash; of near copies with one label one row counts.
    """
    own = labels.where(~held_out(id_column)).groupBy(id_column).agg(F.max(label_column).cast("int").alias("__toxic")).where(f"`{id_column}` is not null and __toxic is not null")
    chosen = own.orderBy(F.xxhash64(id_column), id_column).limit(max_train)  # at most max_train rows: small enough to broadcast
    text = docs.select(F.col(id_column).alias("__id"), texts_or_empty(text_column).alias("__text"))
    rows = text.join(F.broadcast(chosen), F.col("__id") == F.col(id_column)).select("__text", "__toxic")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in small_slices(batches):
            texts = part.column(0).to_pylist()
            words = []
            for text in texts:
                split = text.lower().split()
                restored = {w for t in set(split) for w in restorer.word(t).split()} | restorer.run_words(split)
                words.append(sorted({f for w in restored for f in features(w)}))
            yield pa.RecordBatch.from_arrays([pa.array([_copy_key(t) for t in texts], pa.int64()), part.column(1), pa.array(words, pa.list_(pa.string()))], names=["copy", "toxic", "words"])

    single = rows.mapInArrow(keyed, "copy long, toxic int, words array<string>").groupBy("copy", "toxic").agg(F.min("words").alias("words"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(n: tuple[Counter, Counter]) -> pa.RecordBatch:
            seen = [w for w in n[1]]
            rest = [w for w in n[0] if w not in n[1]]
            return pa.RecordBatch.from_arrays([pa.array(seen + rest, pa.string()), pa.array([n[0][w] for w in seen + rest], pa.int64()), pa.array([n[1][w] for w in seen + rest], pa.int64())], names=["word", "n0", "n1"])

        n = (Counter(), Counter())
        for part in small_slices(batches):
            for toxic, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                n[bool(toxic)].update(words)
            if len(n[0]) + len(n[1]) > 300_000:
                yield told(n)
                n = (Counter(), Counter())
        yield told(n)

    counts = single.select("toxic", "words").mapInArrow(counted, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    share, z2 = F.col("n1") / n, ERRORS**2
    low = (share + z2 / (2 * n) - ERRORS * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    # features of at most max_train rows, three of them toxic or more
    entries = counts.where((low >= LEAST_SHARE) & (F.col("n1") > 2) & (F.col("word") != "")).orderBy("word").collect()
    place = {r.word: i for i, r in enumerate(entries)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            own = [sorted(place[w] for w in words if w in place) for words in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "entries"])

    # at most a row for each training document
    seen = single.select("toxic", "words").mapInArrow(placed, "toxic int, entries array<int>").groupBy("toxic", "entries").agg(F.count("*").alias("n")).collect()
    if not seen:
        return {}, -2.0
    weights, intercept = logistic([(bool(r.toxic), r.entries, r.n) for r in sorted(seen, key=lambda r: (r.toxic, r.entries))], np.array([RIDGE / r.n1**2 for r in entries]))
    return {r.word: float(x) for r, x in zip(entries, weights) if x > 1e-3}, intercept


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id), ``held_out``, ``score`` (0 to 1) and ``predicted`` for each row.

    Only texts are scored; a null text counts as empty and has the score of the
    intercept alone. Null ids are scored, repeated rows alike; with
    no labels at all every score is that of an empty text. Of several labels of
    one id the highest counts.
    """
    keep = [id_column] if keep is None else keep
    model = character_model(docs, text_column)
    lexicon, intercept = fit(docs, labels, model, id_column, text_column, label_column, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, lexicon, intercept)
        for part in small_slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([score(t) for t in part.column(0).to_pylist()], pa.float64())], names=[*keep, "__score"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("__score", DoubleType())])
    scored = docs.select(texts_or_empty(text_column).alias("__text"), *keep).mapInArrow(run, schema)
    return scored.select(*keep, held_out(id_column).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns whatever their names."""
    rows = docs.select(id_column, text_column, F.struct(*docs.columns).alias("__row"))
    scored = score_toxicity(rows, labels, id_column, text_column, keep=[id_column, "__row"])
    return scored.where("predicted = 0").select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
