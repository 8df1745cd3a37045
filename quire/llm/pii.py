"""Personal data by weak-supervision aggregation.

Candidate spans come from the base patterns and from wider ones: spelled-out
addresses, other dotted runs and IPv6, runs of 13 to 19 digits whatever their
check digit, numbers without a country code, and long mixed runs that may be
secrets. Six labelers vote yes, no or not at all on each candidate: pattern,
gazetteer (mail hosts, reserved networks, issuers, country codes, key formats),
context words for and against, edges and shape. Votes are counted as patterns
over all documents. Expectation maximisation estimates how often each labeler
says yes to true and to false candidates, and each pattern's probability; a
logistic span classifier is then fitted to those probabilities over shape
features. Base matches are always kept, and the classifier adds candidates that
touch none of them.

Only counts of (kind, votes, features) patterns reach the driver: at most
``5 * 3**6 * 2**8`` rows whatever the corpus. No pattern backtracks over more
than the characters it is on, so very long texts cost linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, texts_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ADD_AT = 0.9
LABELERS = 6
FEATURES = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDY_AT = re.compile(r" ?[\[(]at[\])] ?| at (?=[A-Za-z0-9-]++ ?(?:[\[(]dot[\])]| dot ))", re.I)
_SPELLED = re.compile(r"[\[(]at[\])]|[\[(]dot[\])]| dot ", re.I)
_WORDY_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]++)++", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_MIXED = re.compile(r"[A-Za-z0-9_-]{16,}+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

#: Context words by kind, mail hosts, issuer prefixes.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "section", "chapter", "ref", "commit", "checksum", "hash", "md5", "sha")
MAIL_HOSTS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "example.com", "example.org", "example.net")
HOST_ENDINGS = ("com", "org", "net", "de", "fr", "es", "edu", "gov", "io", "info", "uk", "it")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "35", "37", "38", "42")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
KEY_LENGTHS = (32, 40, 64, 128)
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers: fours of each dotted run, from its left."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_byte, parts[k : k + 4])):
                yield at, end
            at = end + 1


def cards(text: str, low: int = 16, high: int = 19) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= low:
            digits = run.group().replace(" ", "").replace("-", "")
            if low <= len(digits) <= high and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for run in _PLUS.finditer(text):
            if 8 <= sum(c.isdigit() for c in run.group()) <= 15:
                yield run.span()


BASE: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def _wider(text: str, kind: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        if not _SPELLED.search(text):
            return
        last = 0
        for m in _WORDY_AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            after = _WORDY_DOMAIN.match(text, m.end()) if start < m.start() else None
            if after:
                last = after.end()
                yield start, last
    elif kind == "ip":
        for run in _DOTTED.finditer(text):
            if run.end() - run.start() > 6 and run.group().count(".") == 3:
                yield run.span()
        if ":" in text:
            yield from (m.span() for m in _IPV6.finditer(text))
    elif kind == "card":
        for run in _DIGITS.finditer(text):
            if run.end() - run.start() > 12 and 13 <= sum(c.isdigit() for c in run.group()) <= 19:
                yield run.span()
    elif kind == "phone":
        yield from (m.span() for m in _LOCAL_PHONE.finditer(text))
    else:
        for m in _MIXED.finditer(text):
            own = m.group()
            if not own.isalpha() and any("0" <= c <= "9" for c in own) and any(c.isalpha() for c in own):
                yield m.span()


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` by kind, then start; wider ones touch no base match of any kind."""
    base = {k: list(BASE[k](text)) if k in BASE else [] for k in KINDS}
    taken = sorted(s for own in base.values() for s in own)
    starts = [a for a, _ in taken]
    highest: list[int] = []  # the furthest end so far
    for _, b in taken:
        highest.append(max(b, highest[-1] if highest else 0))
    for kind in KINDS:
        out = [(a, b, True) for a, b in base[kind]]
        for a, b in _wider(text, kind):
            k = bisect_left(starts, b)
            if not k or highest[k - 1] <= a:
                out.append((a, b, False))
        last = -1
        for a, b, is_base in sorted(out):
            if is_base or a >= last:
                yield kind, a, b, is_base
                last = max(last, b)


class Context:
    """The words of a text, found once, by their place."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.ends = [b for _, b in self.spans]
        self.text = text

    def before(self, start: int, count: int = 4) -> list[str]:
        """The last lower-case words that end at ``start`` or before."""
        at = bisect_right(self.ends, start)
        return [self.text[a:b].lower() for a, b in self.spans[max(0, at - count) : at]]


def votes_and_features(context: Context, kind: str, start: int, end: int, base: bool) -> tuple[int, int]:
    """Votes (0 abstain, 1 no, 2 yes) in base three, and binary shape features."""
    text = context.text
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    words = context.before(start)
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    edges = not (before.isalnum() or before in ("-", "_", "/")) and not (after.isalnum() or after in ("_", "/"))
    pattern = base
    if kind == "email":
        local, _, host = span.rpartition("@")
        gazetteer = host.lower().endswith(MAIL_HOSTS) or (host or span).lower().rpartition(".")[2] in HOST_ENDINGS
        shape = 0 < len(local) <= 64 and local[0] != "." and local[-1] != "." and ".." not in span
    elif kind == "ip":
        parts = span.split(".")
        gazetteer = ":" in span or parts[0].lstrip("0") not in ("", "10", "127", "255")
        shape = ":" in span or all(p == "0" or not p.startswith("0") and len(p) < 4 for p in parts)
    elif kind == "card":
        pattern = luhn(digits)
        gazetteer = digits.startswith(ISSUERS)
        shape = len(digits) in (15, 16)
    elif kind == "phone":
        gazetteer = span[0] == "+" and digits.startswith(COUNTRY_CODES)
        shape = 10 <= len(digits) <= 13
    else:
        pattern = _HEX.fullmatch(span) is not None or len(digits) * 8 >= len(span)
        gazetteer = span.startswith(KEY_STARTS) or len(span) in KEY_LENGTHS
        shape = len(set(span)) >= 10
        edges = edges and (before in ("", "'", '"', "=", ":") or before.isspace())
    votes = (
        2 if pattern else 1,
        2 if gazetteer else 1,
        2 if any(w in CONTEXT[kind] for w in words) else 0,
        1 if any(w in AGAINST for w in words) else 0,
        2 if edges else 1,
        2 if shape else 1,
    )
    features = (pattern, gazetteer, shape, edges, len(span) > 12, len(digits) > 9, any(c in span for c in " ()-"), bool(words) and words[-1] in CONTEXT[kind])
    return sum(v * 3**i for i, v in enumerate(votes)), sum(1 << i for i, f in enumerate(features) if f)


def reliabilities(counts: dict[int, float], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation maximisation over vote patterns.

    Gives each pattern's probability; for each labeler how often it says yes to
    true and to false candidates, where it votes; and the share of true ones.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[p // 3**i % 3 for i in range(LABELERS)] for p in patterns])
    yes, no = votes == 2, votes == 1
    says = np.array([np.full(LABELERS, 0.8), np.full(LABELERS, 0.2)])  # a labeler is better than chance until shown
    p, prior = np.full(len(patterns), 0.5), 0.5
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + yes @ np.log(says[0] / says[1]) + no @ np.log((1 - says[0]) / (1 - says[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        for k, weight in enumerate((n * p, n * (1 - p))):
            said, voted = (weight[:, None] * yes).sum(0), (weight[:, None] * (yes | no)).sum(0)
            says[k] = np.clip((said + (8, 2)[k]) / (voted + 10), 0.01, 0.99)
    return dict(zip(patterns, p.tolist())), says, prior


def span_classifier(features: np.ndarray, targets: np.ndarray, weights: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on probabilistic labels; the last weight is the intercept."""
    x = np.c_[features, np.ones(len(features))]
    w, weights = np.zeros(x.shape[1]), weights / weights.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (weights * (p - targets)) + 1e-3 * w
        bend = (x * (weights * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _bits(features: int) -> list[int]:
    return [features >> i & 1 for i in range(FEATURES)]


def fit(docs: DataFrame, text_column: str = "text") -> dict[str, np.ndarray]:
    """A span classifier for each kind that has candidates, from vote counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        for part in small_slices(batches):
            for text in part.column(0).to_pylist():
                found = list(candidates(text))
                context = Context(text) if found else None
                for kind, a, b, base in found:
                    key = (kind, *votes_and_features(context, kind, a, b, base))
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "votes", "features", "n"])

    rows = docs.select(texts_or_empty(text_column)).mapInArrow(run, "kind string, votes int, features int, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    models = {}
    for kind in KINDS:
        own = sorted((r.votes, r.features, r.n) for r in rows if r.kind == kind)
        if own:
            by: dict[int, float] = {}
            for v, _, n in own:
                by[v] = by.get(v, 0) + n
            p, _, _ = reliabilities(by)
            models[kind] = span_classifier(np.array([_bits(f) for _, f, _ in own], float), np.array([p[v] for v, _, _ in own]), np.array([n for _, _, n in own], float))
    return models


def spans_of(text: str, models: dict[str, np.ndarray], add_at: float = ADD_AT) -> list[tuple[str, int, int, bool]]:
    """All spans: base matches, and candidates that the classifier accepts."""
    out, context = [], None
    for kind, a, b, base in candidates(text):
        if not base:
            w = models.get(kind)
            if w is None:
                continue
            context = context or Context(text)
            features = _bits(votes_and_features(context, kind, a, b, base)[1])
            if 1 / (1 + np.exp(-float(np.dot(w[:-1], features) + w[-1]))) < add_at:
                continue
        out.append((kind, a, b, base))
    return out


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the union goes, under the first one's kind."""
    out, last = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    out.append(text[last:])
    return "".join(out)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", models: dict[str, np.ndarray] | None = None, add_at: float = ADD_AT) -> DataFrame:
    """``(id, found ARRAY<STRUCT<kind, start, end, base>>)`` for each row, ordered by kind as listed, then start.

    Offsets are code points of the whole text, ends exclusive. A null or empty
    text has no spans; null ids and repeated rows stay; other columns are ignored.
    """
    models = fit(docs, text_column) if models is None else models
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            found = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans_of(t, models, add_at)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(kind_type))], names=[id_column, "found"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, texts_or_empty(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, found array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact_pii(docs: DataFrame, text_column: str = "text", add_at: float = ADD_AT) -> DataFrame:
    """``docs`` with each found span replaced by its kind; null texts stay null, rows without spans are unchanged."""
    models = fit(docs, text_column)
    names = docs.columns
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            texts = [t if t is None else redact(t, spans_of(t, models, add_at)) for t in part.column(at).to_pylist()]
            columns = list(part.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{c}` {'string' if c == text_column else docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.withColumn(text_column, F.col(text_column).cast("string")).mapInArrow(run, schema)
