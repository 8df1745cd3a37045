"""Operators 1, 4 and 10, the SQL oracles and the pipeline."""

import hashlib
import math
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from cases import awkward, clashing, listed
from test_queries import TABLES, rows as plain_rows

from quire.llm import queries as Q
from quire.llm.pii import KINDS, Context, candidates, find_pii, luhn, redact, redact_pii, reliabilities, spans_of, votes_and_features
from quire.llm.toxicity import Channel, Scorer, log_model, logistic, score_toxicity, spaced_runs, trigram_counts
from quire.llm.url_filter import host_of, judge_urls, match_rules, mine_rules, path_of, tokens_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain_rows(Q.queries()[name](spark, SF).toPandas()) == plain_rows(con.execute(Q.oracle_sql()[name]).fetchdf())


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7/x?q#f", "http://a.example.com/en/8", "ftp://x.net/de/8", "://example.net/de/8", "https://b.org/es/", "https://borg/es/", "none", None, "", "http://com/en/", "http://x.com", "http://x.com?a=/en/", "HTTP://y.NET/de/\n://z"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])] * 2, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame, labels).collect()}
    assert out[0] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") == out[None]
    assert out[1] == ("a.example.com", "/en/8", "com/en/", "block")
    assert out[2] == ("x.net", "/de/8", "net/de/", "allow") and out[3] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert out[4][2:] == ("org/es/", "block") and out[5][2:] == (None, "allow")
    assert out[6] == out[7] == out[8] == ("", "", None, "allow")
    assert out[9] == ("com", "/en/", "com/en/", "block") and out[10] == ("x.com", "", None, "allow") == out[11]
    assert out[12] == ("y.net", "/de/\n://z", "net/de/", "allow")
    assert listed(judge_urls(clashing(frame), labels)) == listed(judge_urls(frame, labels))
    assert judge_urls(frame.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.site.dev/{'x' if i % 2 else 'y'}/{i}") for i in range(400)]
    labels = [(i, int(i % 4 != 0), None if i % 3 else 0) for i in range(0, 200)]
    out = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + labels[:9] + [(None, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in range(400) if i % 4 == 0} and len(out) == 400
    sets = spark.createDataFrame([(["a", "b", "c"],), (["a"],), (["b2", "a"],), ([],)], "tokens array<string>")
    items = spark.createDataFrame([("a", "a"), ("b", "b"), ("b2", "b"), ("c", "c"), ("d", "d")], "token string, item string")
    rules = spark.createDataFrame([(["a", "b"], 0.7), (["c"], 0.9), (["a", "d"], 1.0)], "rule array<string>, confidence double")
    assert {(tuple(r.tokens), r.confidence) for r in match_rules(sets, items, rules).collect()} == {(("a", "b", "c"), 0.9), (("b2", "a"), 0.7)}


def slow_rules(rows, min_support, min_confidence):
    """Every combination of tokens, one after the other."""
    least = math.ceil(min_support * len(rows))
    out = {}
    for tokens, _ in rows:
        for size in range(1, len(tokens) + 1):
            for rule in combinations(sorted(tokens), size):
                if rule not in out:
                    hit = [b for t, b in rows if set(rule) <= set(t)]
                    out[rule] = sum(hit) / len(hit) if sum(hit) >= least and sum(hit) / len(hit) >= min_confidence else None
    return {r: c for r, c in out.items() if c is not None}


def test_rules_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):  # only all five together are bad
        tokens = [f"t{k}" for k in range(5) if rng.random() < 0.8]
        rows.append((tokens + [f"u{int(rng.integers(0, 3))}"], len(tokens) == 5))
    rows += [(["deep"] + [f"p{k}=x" for k in range(40)], True)] * 6  # one long shared path is one item
    rows += [(["t0", "t1", "t2", "t3"], False)] * 30
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    items, rules = mine_rules(frame, 0.03, 0.6)
    assert len({r.item for r in items.collect() if r.token.startswith("p")}) == 1
    short = [(t, b) for t, b in rows if "deep" not in t]
    slow = slow_rules(short + [(["deep"], True)] * 6, 0.03, 0.6)
    asked = [sorted(set(t)) for t, _ in rows] + [["p7=x", "u0"], ["t0", "t1", "t2", "t3", "t4"], ["p9"]]
    expected = {}
    for t in asked:
        own = [c for r, c in slow.items() if set(r) <= set(t) | ({"deep"} if any(x.startswith("p") and "=" in x for x in t) else set())]
        if own:
            expected[tuple(t)] = max(own)
    assert any(len(r) > 3 for r in slow)
    got = match_rules(spark.createDataFrame([(t,) for t in asked], "tokens array<string>").distinct(), items, rules)
    assert {tuple(r.tokens): round(r.confidence, 9) for r in got.collect()} == {t: round(c, 9) for t, c in expected.items()}


def test_every_segment_is_a_token(spark):
    url = "http://a.b.c.example.com/x/y/z/deep/way/down/12.html?b=1&a=2"
    frame = spark.createDataFrame([(url,)], "u string").select(tokens_of(F.col("u"), host_of(F.col("u")), path_of(F.col("u"))).alias("t"))
    own = frame.first().t
    assert {"h1=com", "h4=b.c.example.com", "h5=a.b.c.example.com"} < set(own) and {"p1=x", "p4=deep", "p6=down", "p7=0.html", "x=html", "q=a&b"} < set(own) and len(own) == 14


def slow_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


PII = [
    "mail a.b+c@x.example.com, x@y, a@b.c@d.ef z@@q.de me@host. @a.b", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 001.002.003.255 1..2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 378282246310005",
    "call +1 (988) 555-2485 or +49.30-123456 +1 2 +123456789012345678 (366) 555-9807", "é🙂 ü@ü.de a@bé.de 日本+81 3 1234 5678", "write to joe at example dot com or joe [at] mail [dot] org", "ip fe80:0:0:0:1:2:3:4 login", "",
]


def test_base_spans():
    rng = np.random.default_rng(0)
    parts = ["a", "@", ".", "1", "25", "300", " ", "-", "+", "(", ")", "example.com", "4111111111111111", "é", "x.y", "\n"]
    for text in PII + ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(4000)]:
        own = [s[:3] for s in spans_of(text, {}) if s[3]]
        assert own == slow_spans(text), text


def test_pii_rows(spark):
    frame = awkward(spark, [(20 + i, t, "en", "s", 1) for i, t in enumerate(PII * 3)])
    out = find_pii(frame)
    for r in out.collect():
        assert [KINDS.index(s.kind) for s in r.found] == sorted(KINDS.index(s.kind) for s in r.found)
    assert listed(find_pii(clashing(frame))) == listed(out) and out.count() == frame.count()
    assert find_pii(frame.limit(0)).count() == 0
    clean = redact_pii(frame)
    assert clean.columns == frame.columns and clean.count() == frame.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[2] is None and texts[20].startswith("mail [EMAIL], x@y") and "[CARD]" in texts[22] and "[PHONE]" in texts[23]
    assert redact("ab", [("ip", 0, 2, True), ("card", 1, 2, True)]) == "[IP]"


def test_reliabilities_find_the_better_labeler():
    rng = np.random.default_rng(2)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = [(2 if truth else 1) if rng.random() < a else (1 if truth else 2) for a in (0.95, 0.9, 0.6, 0.9, 0.6, 0.6)]
        key = sum(v * 3**i for i, v in enumerate(votes))
        counts[key] = counts.get(key, 0) + 1
    _, says, prior = reliabilities(counts)
    gap = says[0] - says[1]  # how much likelier a yes is on a true candidate
    assert gap[[0, 1, 3]].min() > 0.65 > 0.4 > gap[[2, 4, 5]].max() and 0.4 < prior < 0.6


def test_labelers_disagree():
    of = lambda text, kind, base=False: [votes_and_features(Context(text), k, a, b, c) for k, a, b, c in candidates(text) if k == kind and c == base]
    card = of("pay by card 4111111111111112 or 9999999999999999, order 4111111111111112x", "card")
    assert len({v for v, _ in card}) == 3
    votes = [v // 3**i % 3 for i in range(6) for v in [card[0][0]]]
    assert votes == [1, 2, 2, 0, 2, 2]
    assert of("token = " + "x" * 5 + " " * 500 + "0123456789abcdef0123456789abcdef", "secret")[0][0] // 9 % 3 == 2  # context has no window of characters
    text = f"write to {'a' * 200}.b (at) {'.'.join(['mail'] * 9)} dot org"
    (kind, start, end, base), = candidates(text)
    assert (kind, text[start:end], base) == ("email", text[9:], False)
    assert [k for k, *_ in candidates("commit " + "a1" * 20 + " 10.1.2.300 (366) 555-9807")] == ["ip", "phone", "secret"]


def test_digest_columns(spark):
    texts = PII * 3 + [f'key = "{k:032x}"' for k in range(10**36, 10**36 + 40)] + [None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in Q.pii_digest(find_pii(frame)).collect():
        base = slow_spans(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        spans = [s for s in r.spans.split(",") if s]
        assert set(told.split(",")) - {""} <= set(spans) and r.n_added == len(spans) - len(base)
        assert [KINDS.index(s.split(":")[0]) for s in spans] == sorted(KINDS.index(s.split(":")[0]) for s in spans)
        if r.doc_id >= len(PII) * 3 and r.doc_id < len(texts) - 1:
            assert spans == [f"secret:7:{len(texts[r.doc_id]) - 1}"]


def test_spans_are_added_on_the_tables(spark):
    out = Q.op4_pii(spark, "/root/testdata/sf0.01").agg({"n_added": "sum"}).first()[0]
    assert out > 0


PROSE = "the idiot and the moron are not a pathetic clown, a loser is trash and scum; stupid sit still at a mill"


def channel():
    return Channel(log_model(trigram_counts([PROSE] * 20)))


def test_noisy_channel():
    own = channel()
    for noisy, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "idiooooot": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "idiot": "idiot", "idiot!!": "idiot", "42": "42", "p@thetic": "pathetic"}.items():
        assert own.restore(noisy) == word, noisy
    for noisy, words in {"i d i o t": "idiot", "id iot": "idiot", "i d i o t m o r o n": "idiot moron", "a m o r o n": "a moron", "iddiot": "idiot", "the clown": "the clown", "s c u m, a": "scum a"}.items():
        assert own.decode(noisy) == words, noisy
    assert own.restore("i.d.i.o.t." * 60) == "idiot" * 60 and own.decode("i d i o t " * 80) == " ".join(["idiot"] * 80)


def all_paths(own, text, a=0, b=0, last="", score=0.0, words=""):
    """Every path through the lattice, one after the other."""
    if not text:
        yield score + (own.model[a][b][0] if b else 0.0), " ".join(words.split())
        return
    ch, rest = text[0], text[1:]
    letters, noise = own.options(ch)
    if noise is not None:
        yield from all_paths(own, rest, a, b, last, score + noise, words)
    for letter, cost in letters:
        if letter == last:
            yield from all_paths(own, rest, a, b, last, score + cost + (own.REPEAT if letter else 0), words)
        if letter or last:
            c = ord(letter) - 96 if letter else 0
            yield from all_paths(own, rest, b, c, letter, score + cost + own.model[a][b][c], words + (letter or " "))


def test_viterbi_finds_the_best_of_all_paths():
    own, rng = channel(), np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("idotsmr1160!. @"), rng.integers(1, 9)))
        paths = list(all_paths(own, text))
        score, words = own.best(text)
        assert abs(score - max(p[0] for p in paths)) < 1e-9, text
        assert any(abs(s - score) < 1e-9 and w == " ".join(words) for s, w in paths), text
        for _, word in paths[:: max(1, len(paths) // 5)]:
            if word and " " not in text:
                assert abs(own.own_path(text, word) - max(s for s, w in paths if w == word)) < 1e-9, (text, word)


def test_runs_of_spaced_letters():
    assert list(spaced_runs("you I D I O T. there a man of a town".split())) == ["you I D I O T there"]
    assert list(spaced_runs("a m or on x".split())) == ["a m or on x"] and list(spaced_runs("x".split())) == list(spaced_runs([])) == []


def test_scores_of_disguised_words():
    score = Scorer(log_model(trigram_counts([PROSE] * 20)), {"idiot": 4.0, "moron": 4.0, "scum": 3.0, "path*": 0.1}, -3.0)
    for text, words in {
        "you I D I O T.": {"idiot"}, "a m o r o n": {"moron"}, "i d i o t m o r o n": {"idiot", "moron"}, "id i ot!": {"idiot"}, "mo ron and idioot": {"idiot", "moron"}, "iddiot": {"idiot"},
        "S.C.U.M": {"scum"}, "!d!ot": {"idiot"}, "1.d.1.0.t." * 70: set(), "m0 r0n": {"moron"}, "the 1 d 1 0 t and": {"idiot"}, "a pathetic": {"pathetic"}, "the clown": set(), "x" * 9000 + " s c u m": {"scum"},
    }.items():
        assert set(score.words(text)) == words, text
    assert score("") == score("the clown") < 0.3 < score("id iot") and 0 <= score("idiot moron scum " * 500) <= 1


def test_rare_words_weigh_little():
    toxic = [(True, [0], 40), (True, [0, 2], 3), (True, [1], 30), (False, [], 500), (False, [2], 1)]
    weights, intercept = logistic(toxic, np.array([20 / 43**2, 20 / 30**2, 20 / 3**2]))
    p = lambda *f: 1 / (1 + np.exp(-(intercept + sum(weights[k] for k in f))))
    assert p(0) > 0.9 and p(1) > 0.9 and p(2) < 0.3 and p() < 0.05


def test_toxicity(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}or" for k in range(200)]
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(700):
        own = list(rng.choice(words, 30))
        toxic = int(i % 7 == 0)
        if toxic:
            own[rng.integers(0, 30)] = str(rng.choice(["grubnak", "zoltrip"])) if i % 14 else "gr*u*b*nak"
        docs.append((50 + i, " ".join(own), "en", "s", 1))
        labels.append((50 + i, 1, toxic))
    frame, marks = awkward(spark, docs), spark.createDataFrame(labels + labels[:5] + [(None, 0, 1), (51, None, None)], "doc_id long, quality int, toxic int")
    out = score_toxicity(frame, marks)
    rows = out.collect()
    truth = {i: t for i, _, t in labels}
    assert len(rows) == frame.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    seen = [(truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth]
    assert sum(a == b for a, b in seen) >= 0.97 * len(seen)
    assert listed(score_toxicity(clashing(frame), marks)) == listed(out)
    assert score_toxicity(frame.limit(0), marks).count() == 0
    assert {r.predicted for r in score_toxicity(frame, marks.limit(0)).collect()} == {0}


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == names and 0 < docs.count() <= before.count(), name
    assert not any(s[3] for r in docs.collect() for s in spans_of(r.text or "", {}))
    texts = {r.doc_id: r.text for r in docs.collect()}
    from tokenizers import Tokenizer

    library, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, t in texts.items():
        expected[i] = len(library.encode(t or "", add_special_tokens=False).ids) + 1
    packed = C.run(spark, SF).collect()
    assert len({f.split("/")[-2] for f in C.run(spark, SF).inputFiles()}) == 1
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == expected
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES][0] == "toxicity"


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["predicted", "score", "held_out", "__score", "removed_spans", "removed_chars", "__row", "__rest", "__others", "__rank", "__id", "rank", "a b"]
    frame = clashing(awkward(spark)).select("*", *(F.lit("kept").alias(n) for n in names if n not in clashing(awkward(spark)).columns))
    frame = frame.withColumn("removed_spans", F.lit("kept")).withColumn("predicted", F.lit("kept"))
    ids = {str(r.doc_id) for r in frame.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        rows = out.collect()
        assert len(rows) >= 6 and {str(r.doc_id) for r in rows} <= ids, name
        assert all(r[n] == "kept" for r in rows for n in ("predicted", "removed_spans", "removed_chars", "__row", "a b")), name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_ties_of_near_dedup_are_settled(spark):
    from quire.llm.jaccard import drop_similar
    from quire.llm.simhash import drop_near_duplicates

    rows = [(1, "one text of two rows here", f"s{k}") for k in range(6)]
    for op in (drop_similar, drop_near_duplicates):
        for order in (rows, rows[::-1]):
            assert [r.source for r in op(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()] == ["s0"]
        assert op(spark.createDataFrame([("x", "a"), ("y", "b")], "doc_id string, text string")).count() == 2


def test_awkward_rows_through_the_stages(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() > 0
