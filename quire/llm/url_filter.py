"""URL filtering by association rules, in DataFrame operations alone.

Every url becomes a set of tokens: all host suffixes, all path segments with
their place, file ending, query keys. FP-growth mines token combinations of any
size over the urls that have labels. Combinations that are frequent enough and
lead to the bad label with enough confidence become rules; an inverted index
from token to rule finds the rules whose tokens a url has all of. Listed rules
come before mined ones.

Tokens that the same labelled urls have are one item while mining, and a url has
that item if it has any of them. A combination of items stands for every
combination of such tokens, all of one support and confidence, so nothing is lost
and long paths that many urls share do not multiply. Tokens of too few bad urls
are in no rule and are left out before mining.

Urls are matched by distinct token set, so equal sets are matched once however
many urls share them.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path)
LISTED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "label=bad"
#: Share of the labelled urls that are bad and have all tokens of a rule.
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.6
#: Tasks over which the urls of one token set are spread where they learn its verdict.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The url's tokens, sorted; digits in path segments are all one digit."""
    labels = F.reverse(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit("="), F.array_join(F.reverse(F.slice(labels, 1, n)), ".")))
    parts = F.filter(F.split(F.regexp_replace(F.translate(path, _UPPER, _LOWER), "[0-9]+", "0"), "/"), lambda s: s != "")
    segments = F.transform(parts, lambda s, i: F.concat(F.lit("p"), (i + 1).cast("string"), F.lit("="), s))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"^([^=]*)", 1)))), "&")
    others = F.array(F.when(ending != "", F.concat(F.lit("x="), F.translate(ending, _UPPER, _LOWER))), F.when(query != "", F.concat(F.lit("q="), keys)))
    hosts = F.when(host != "", suffixes).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(hosts, segments, others))))


def document_of(path: Column) -> Column:
    """The document that a url names: its first path segment that starts with a number; null without one."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("bigint")


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """From ``(tokens, bad BOOLEAN)``: items ``(token, item)`` and rules ``(rule ARRAY<item>, confidence)``, over all labelled urls."""
    sets = checkpointed(labelled.where((F.size("tokens") > 0) | F.col("bad")).groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(min_support * total))
    one = sets.select(F.explode("tokens").alias("token"), "tokens", "n", "n_bad")
    seen = one.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.bit_xor(F.xxhash64("tokens")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "tokens")).alias("b")).where(F.col("n_bad") >= least)
    key = ["a", "b", "n", "n_bad"]  # tokens of the same token sets
    items = seen.select("token", *key).join(seen.groupBy(*key).agg(F.min("token").alias("item")), key).select("token", "item")
    itemised = sets.join(one.join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items")), "tokens", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    bad = itemised.select(F.array_append("items", F.lit(BAD)).alias("items"), F.col("n_bad").alias("n"))
    rows = bad.unionByName(itemised.select("items", (F.col("n") - F.col("n_bad")).alias("n"))).where("n > 0")
    baskets = rows.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("items")
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support), minConfidence=min_confidence).fit(baskets).associationRules
    return items, rules.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("rule"), "confidence")


def match_rules(token_sets: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, confidence)``: the best rule of each token set that has one, by inverted index."""
    index = rules.select(F.explode("rule").alias("item"), "rule", F.size("rule").alias("size"), "confidence")
    having = token_sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token").select("tokens", "item").distinct()
    full = having.join(index, "item").groupBy("tokens", "rule", "size", "confidence").agg(F.count("*").alias("n")).where("n = size")
    return full.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", label_key: str = "doc_id", rules: tuple = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(id, host, path, rule, verdict, confidence)`` for each url.

    A listed rule decides where one fits, the longest first; else a mined rule
    blocks, and its confidence is told; else the url is allowed. Labels are those
    of the document that the url names: bad are rows of low quality or marked
    toxic (of several labels of one key any counts). Null urls have empty host
    and path, no tokens and no label; null ids are judged like any; repeated rows
    come out repeated; without labels nothing is mined. Other columns are ignored.
    """
    own = pages.select(F.col(id_column).alias("__id"), F.col(url_column).cast("string").alias("__url"))
    own = own.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    own = own.withColumn("tokens", F.coalesce(tokens_of(F.col("__url"), F.col("host"), F.col("path")), F.array().cast("array<string>")))
    bad = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("__key")).agg(F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("bad"))
    items, mined = mine_rules(own.join(bad, document_of(F.col("path")) == bad["__key"]).select("tokens", "bad"), min_support, min_confidence)
    matched = match_rules(own.select("tokens").distinct(), items, mined).withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rule, listed = listed_rule(F.col("host"), F.col("path"), rules)
    judged = own.withColumn("__salt", F.pmod(F.xxhash64("__id", "__url"), F.lit(SALTS)).cast("int")).join(matched, ["tokens", "__salt"], "left")
    verdict = F.coalesce(listed, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("__id").alias(id_column), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(listed.isNull(), F.col("confidence")).alias("confidence"))
