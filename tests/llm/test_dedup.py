"""Operators 3, 6, 7 and 9 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from cases import awkward, clashing, listed
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from quire.llm.blocks import gridded
from quire.llm.components import connected_components
from quire.llm.embedding import near_duplicate_vectors
from quire.llm.jaccard import drop_similar
from quire.llm.simhash import drop_near_duplicates, fingerprint, hamming_links, near_duplicates
from quire.llm.substring import cut_repeats, remove_repeats, unit_words
from quire.llm.topk import floors_of, search_bucket, top_k, with_floors


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == union_find(linked, [(a, b) for a, b in links if a != b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50, 199, 201, 203, 700):
        text = " ".join(rng.choice(["A", "bé", "İx", "c\u00a0d", "E\te", "f\x1cg"]) for _ in range(n))
        assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("radius, segments", [(2, 3), (2, 9), (0, 1), (3, 7)])
def test_hamming_links_keep_components(spark, radius, segments):
    rng = random.Random(6)
    fps = set()
    for _ in range(60):
        own = rng.getrandbits(64)
        fps.add(own)
        for _ in range(rng.randint(0, 6)):
            own ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(own)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)}  # one dense group
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    expected = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if near(a, b)])
    links = hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, segments, block=16)
    got = {x: x for x in fps} | {r.node: r.component for r in connected_components(links).collect()}
    assert got == expected
    assert all(near(r.u, r.v) or expected[r.u] == expected[r.v] for r in links.collect())


def near_texts():
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(400)) for _ in range(6)]
    return [(10 + i, t if i % 3 else t.rsplit(" ", 1)[0], "en", "s", 1) for i, t in enumerate(base * 4)]


def test_near_duplicates(spark):
    frame = awkward(spark, near_texts())
    rows = [(r.doc_id, slow_fingerprint(r.text or "")) for r in frame.collect()]
    fps = sorted({f for _, f in rows})
    of = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    expected = sorted(str((i, f"{f:016x}", least.get(of[f]))) for i, f in rows)
    assert sorted(str(tuple(r)) for r in near_duplicates(frame).collect()) == expected
    assert listed(near_duplicates(clashing(frame))) == listed(near_duplicates(frame))
    assert near_duplicates(frame.limit(0)).count() == 0
    kept = drop_near_duplicates(clashing(frame))
    assert kept.columns == clashing(frame).columns and kept.count() == len(set(of.values()))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least.get(c)) for c in set(of.values()))


def edited_texts():
    """Copies with changed words, of many similarities; one large group of near copies."""
    rng = random.Random(31)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 999))
    rows = []
    for group in range(40):
        base = [word() for _ in range(rng.choice([4, 5, 30, 120, 400]))]
        for _ in range(60 if group == 3 else 5):
            own = list(base)
            for at in rng.sample(range(len(own)), min(len(own), rng.randint(0, 1 + len(own) // 40))):
                own[at] = word()
            rows.append((len(rows) + 1000, " ".join(own), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_dedup_stage_finds_edited_copies(spark, block):
    frame = awkward(spark, edited_texts())
    sets = {}
    for r in frame.collect():
        words = (r.text or "").lower().split()
        key = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        sets[key] = min(sets.get(key, 10**9), 10**9 if r.doc_id is None else r.doc_id)
    nodes = list(sets)
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    of = union_find(range(len(nodes)), [(i, j) for i in range(len(nodes)) for j in range(i) if near(nodes[i], nodes[j])])
    least = {}
    for k, root in of.items():
        least[root] = min(least.get(root, 10**9), sets[nodes[k]])
    assert len(least) < len(nodes) - 60
    kept = drop_similar(frame, block=block) if block != 1024 else dict(STAGES)["near-dedup"](spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert drop_similar(frame.limit(0)).count() == 0


def slow_set_fingerprint(key):
    h = [xxhash.xxh64_intdigest(" ".join(words), 42) for words in key]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius, segments", [(10, 11), (4, 9)])
def test_near_dedup_stage_goes_by_fingerprints(spark, radius, segments):
    """Without the keys of minima, sets that pigeonring search joins and whose similarity suffices."""
    frame = awkward(spark, edited_texts())
    sets = {}
    for r in frame.collect():
        words = (r.text or "").lower().split()
        key = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        sets[key] = min(sets.get(key, 10**9), 10**9 if r.doc_id is None else r.doc_id)
    nodes = list(sets)
    fps = [slow_set_fingerprint(key) for key in nodes]
    pairs = [(i, j) for i in range(len(nodes)) for j in range(i)]
    group = union_find(range(len(nodes)), [(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= radius])
    similar = [(i, j) for i, j in pairs if 5 * len(nodes[i] & nodes[j]) >= 4 * len(nodes[i] | nodes[j])]
    of = union_find(range(len(nodes)), [(i, j) for i, j in similar if group[i] == group[j]])
    least = {}
    for k, root in of.items():
        least[root] = min(least.get(root, 10**9), sets[nodes[k]])
    assert len(least) < len(nodes) - 10
    kept = drop_similar(frame, radius=radius, segments=segments, bands=0)
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_dedup_stage_searches_fingerprints_first(spark, monkeypatch):
    """The stage runs pigeonring search; groups of a key that it has joined are not compared again."""
    from quire.llm import jaccard

    searched, compared, links = [], [], jaccard.similar_links
    monkeypatch.setattr(jaccard, "hamming_links", lambda nodes, radius, segments: searched.append((nodes.count(), radius, segments)) or hamming_links(nodes, radius, segments))

    def spied(docs, nodes, groups, *more):
        compared.append(groups)
        return links(docs, nodes, groups, *more)

    monkeypatch.setattr(jaccard, "similar_links", spied)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[: 300 - k])) for k in range(4)]  # differ in a few shingles of 296
    kept = dict(STAGES)["near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r.doc_id for r in kept.collect()] == [0]
    assert searched == [(len({slow_set_fingerprint({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for _, t in rows}), 10, 11)]
    first, rest = compared
    assert first.select("key").distinct().count() == 1 and first.count() == 4
    assert rest.count() == 80 and rest.select("piece").distinct().count() == 1
    cells = gridded(rest, ["key"], F.xxhash64("node"), 1024, "node", "piece")
    assert cells.count() == 0 and gridded(rest, ["key"], F.xxhash64("node"), 1024, "node").count() > 0


def slow_repeats(rows, min_words):
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            continue
        _, forms, counts = unit_words(text)
        again = []
        for k, (f, n) in enumerate(zip(forms, counts)):
            if n and f in seen:
                again.append(k)
            elif n:
                seen.add(f)
        out[i, text] = cut_repeats(text, again, min_words)
    return out


def test_every_repeat_goes_without_a_minimum(spark):
    rows = [(1, "One.\nTwo words. Three words here\nOne."), (2, "ONE.\nFour. Two  words."), (3, "Five"), (None, "five"), (4, "Six seven")]
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    assert {i: (r.text, r.removed_spans) for i, r in out.items()} == {
        1: ("One.\nTwo words. Three words here\n", "33:37"), 2: ("Four. ", "0:5,11:22"), 3: ("Five", ""), None: ("", "0:4"), 4: ("Six seven", "")
    }
    texts = remove_repeats(spark.createDataFrame([("a", "same " * 20), ("b", "same " * 20)], "doc_id string, text string")).collect()
    assert len(texts) == 2


def slow_cut(rows, min_words):
    """Repeats by their words alone, written apart from the operator: lines cut after sentence ends."""
    seen, out = set(), {}
    for i, text in rows:
        gone, run = [], []
        at = 0
        for unit in re.findall(r"[^\n]*?[.!?]\s|[^\n]*\n|[^\n]+$", text):
            form = tuple(unit.lower().split())
            if form and form in seen:
                run.append((at, at + len(unit), len(form)))
            else:
                gone.append(run) if run else None
                run = []
                seen.add(form)
            at += len(unit)
        gone.append(run) if run else None
        out[i] = ",".join(f"{r[0][0]}:{r[-1][1]}" for r in gone if sum(x[2] for x in r) >= min_words)
    return out


@pytest.mark.parametrize("min_words", [1, 6, 12])
def test_units_against_an_independent_cut(spark, min_words):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    pool = [" ".join(word() for _ in range(rng.randint(1, 8))) + "." for _ in range(40)]
    rows = [(i, "".join((rng.choice(pool) if rng.random() < 0.4 else " ".join(word() for _ in range(5)) + "!") + rng.choice([" ", "\n"]) for _ in range(15))) for i in range(40)]
    import quire.llm.substring as S

    whole = S.windows
    try:
        S.windows = lambda text, size=12: ([], [])  # units alone
        spans = {i: None for i, _ in rows}
        units = {}
        seen = set()
        for i, text in rows:
            _, forms, counts = S.unit_words(text)
            again = [k for k, (f, n) in enumerate(zip(forms, counts)) if n and (f in seen or seen.add(f))]
            units[i] = again
            spans[i] = ",".join(f"{a}:{b}" for a, b in S.cut_repeats(text, again, min_words)[1])
    finally:
        S.windows = whole
    assert spans == slow_cut(rows, min_words)


def test_substring_dedup(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(2, 9))).capitalize() + rng.choice([".", "!", "?"])
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(5)]
    rows = [(i, rng.choice(["\n", " "]).join(sentence() if rng.random() < 0.7 else rng.choice(passages) for _ in range(12))) for i in range(60)]
    rows += [(100, "Only here. " + passages[0] + "\nEnd İstanbul."), (101, None), (102, ""), (None, passages[1]), (103, "\n\n\n")]
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("removed_spans", F.lit("clash")).withColumn("rank", F.lit(1))
    expected = slow_repeats(rows, 12)
    out = remove_repeats(frame).collect()
    assert len(out) == len(rows) + 3
    seen = [t for i, t in rows if i == 100]
    for r in out:
        if r.text is None:
            assert r.doc_id == 101 and r.removed_spans == ""
            continue
        own = [v for (i, _), v in expected.items() if i == r.doc_id]
        assert (r.text, r.removed_spans) in [(t, ",".join(f"{a}:{b}" for a, b in s)) for t, s in own]
    cut = next(r for r in out if r.doc_id == 100)
    (a, b), = [tuple(map(int, s.split(":"))) for s in cut.removed_spans.split(",")]
    assert passages[0] in seen[0][a:b] + " " and cut.text == seen[0][:a] + seen[0][b:] and cut.text.startswith("Only here. ")
    assert remove_repeats(frame.limit(0)).count() == 0
    assert remove_repeats(awkward(spark)).count() == awkward(spark).count()


def test_substring_dedup_inside_sentences(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [words(n) for n in (19, 50, 66)] + [f"{words(20)}. {words(3)}. {words(5)}! {words(24)}"]
    rows = [(10 * i + k, f"{words(9)}. {words(7)} {p} {words(6)}. {words(8)}.") for i, p in enumerate(passages) for k in range(3)]
    rows += [(900, f"{words(30)} " + "same " * 60 + words(30)), (901, "same " * 40 + words(20)), (902, words(80))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in remove_repeats(frame).collect()}
    for i, p in enumerate(passages):
        assert out[10 * i].removed_chars == 0
        for k in (1, 2):
            r, text = out[10 * i + k], dict(rows)[10 * i + k]
            (a, b), = [tuple(map(int, s.split(":"))) for s in r.removed_spans.split(",")]
            assert r.text == text[:a] + text[b:] and text[a:b].strip() in p
            before, after = (len(x.split()) for x in p.split(text[a:b].strip()))
            assert before < 8 and after < 8
    assert out[900].text.split().count("same") >= 12 and len(out[900].text.split()) <= 60 + 12 + 14
    assert out[901].text.split().count("same") <= 14 and out[901].text.split()[-20:] == rows[-2][1].split()[-20:]
    assert out[902].removed_chars == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        v = rng.normal(size=8)
        for k in range(int(rng.integers(1, 6))):
            rows.append((len(rows), [float(x) for x in np.float32(v + rng.normal(size=8) * 0.08)], int(i % 3)))
    copy = rows[5]
    rows += [(len(rows) + k, copy[1], copy[2]) for k in range(40)]
    nan = float("nan")
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [nan] * 8, 1), (903, [None] * 8, 1), (904, [], 1), (905, rows[0][1], None), (906, [float("inf")] * 8, 1), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [-0.0] * 7 + [1.0], 2), (910, [0.0] * 7 + [5.0], 2)]
    return rows


def slow_links(rows):
    usable = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (np.array(v, float), label)
    links = {i: set() for i, _, _ in rows}
    for i, (a, la) in usable.items():
        for j, (b, lb) in usable.items():
            if i < j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("floats, blocks", [(4_194_304, (4096, 16_384)), (4_194_304, (16, 24)), (8 * 9, (16, 24)), (0, (16, 24))])
def test_vector_near_duplicates(spark, monkeypatch, floats, blocks):
    import quire.llm.embedding as E

    own = E.cell_links
    monkeypatch.setattr(E, "cell_links", lambda placed, threshold: own(placed, threshold, *blocks))
    rows = vector_rows()
    links = slow_links(rows)
    of = union_find([i for i, _, _ in rows], [(i, j) for i, own in links.items() for j in own])
    expected = sorted((i, len(links[i]), of[i], of[i] == i) for i, _, _ in rows)
    frame = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, near_duplicate_vectors(frame, pivot_floats=floats).collect())) == expected
    if not floats:
        assert near_duplicate_vectors(clashing(frame.limit(0))).count() == 0
        twice = near_duplicate_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None)], VECTORS))
        assert sorted(map(str, map(tuple, twice.collect()))) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)]))


def test_vectors_with_clashing_columns_and_many_components(spark):
    wide = [(i, [float((i * 7 + k) % 11) for k in range(5000)], 1) for i in range(12)]
    frame = spark.createDataFrame(wide, VECTORS)
    assert listed(near_duplicate_vectors(clashing(frame).drop("label").withColumn("label", F.lit(1)))) == listed(near_duplicate_vectors(frame))


def test_pivots_grow_and_cut_cells(spark):
    from quire.llm.embedding import cell_rows, choose_pivots

    rng = np.random.default_rng(2)
    hubs = rng.normal(size=(40, 16))
    rows = [(f"n{i:05}", int(i >= 100), [float(v) for v in np.float32(hubs[i % 40] + rng.normal(size=16) * 0.02)], 1, 16) for i in range(4400)]
    nodes = spark.createDataFrame(rows, "node string, label int, vec array<float>, n long, dim int").cache()
    pivots = choose_pivots(nodes)
    assert 2 <= len(pivots[0, 16]) < len(pivots[1, 16]) <= 40
    placed = cell_rows(nodes, pivots, 0.05).groupBy("pivot", "label").agg(F.count("*").alias("all"), F.sum(F.col("home").cast("int")).alias("own")).collect()
    assert sum(r.own for r in placed) == 4400 and sum(r.all * r.own for r in placed) < 0.25 * (100**2 + 4300**2)


def slow_top(rows, k, every):
    own = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in own if i % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q and len(a) == len(b))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rows = vector_rows(5) + [(1000, [1e6] * 8, 1), (1001, [3e5] * 8, 1), (None, [1.0] * 8, 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    for sizes in ({}, {"bucket_floats": 160, "query_floats": 24, "seed_floats": 96}, {"seed_floats": 8}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, k=4, every=20, **sizes).collect())
        assert got == slow_top(rows, 4, 20)
    assert top_k(clashing(frame).limit(0)).count() == 0
    assert sorted(map(str, top_k(clashing(frame), k=4, every=20).collect())) == sorted(map(str, top_k(frame, k=4, every=20).collect()))


def test_two_vectors_of_one_id(spark):
    frame = spark.createDataFrame([(0, [1.0, 5.0], 1), (0, [1.0, 2.0], 1), (3, [1.0, 1.0], 1), (4, [0.0, 2.0], 1)], VECTORS)
    for order in (frame, frame.orderBy(F.desc("embedding"))):
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(order, k=2).orderBy("rank").collect()] == [(0, 1, 4, 4 * 2**20), (0, 2, 3, 3 * 2**20)]


@pytest.mark.parametrize("spread, share", [(0.0, 1.0), (1.5, 0.1)])
def test_pruned_search_is_exact(spread, share):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(6000, 6)) * 50 * np.exp(rng.normal(size=(6000, 1)) * spread))
    ids = rng.permutation(6000)
    longest = np.argsort(-(x * x).sum(1))[:64]
    for floors in (None, floors_of(x[:20], ids[:20], x[longest], ids[longest], 5)):
        q, found, score, computed = search_bucket(x[:20], ids[:20], x, ids, 5, step=64, floors=floors)
        assert computed <= share * 20 * 6000
        for k in range(20):
            full = (x @ x[k]).astype(int)
            order = sorted((-s, i) for s, i in zip(full.tolist(), ids.tolist()) if i != ids[k])[:5]
            assert sorted((-s, i) for s, i in zip(score[q == k].tolist(), found[q == k].tolist())) == order


def test_short_buckets_are_not_moved(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4) * 10.0 ** (2 - i % 50 // 10)], 1) for i in range(3000)]
    frame = spark.createDataFrame(rows, VECTORS)
    out = top_k(frame, k=3, every=50)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == slow_top(rows, 3, 50)
    with_norm = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(4).alias("dim"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.floor(v * 1024) * F.floor(v * 1024))).alias("norm"))
    floors = {r.id: r.floor / r.norm for r in with_floors(with_norm.where("id % 50 = 0"), with_norm, 3, 1024, 256).collect()}
    lengths = np.array([r.norm for r in with_norm.collect()])
    reached = sum(int((lengths >= f).sum()) for f in floors.values())
    assert reached < 0.3 * len(lengths) * len(floors)
