"""Operators 2, 5 and 8 against the public libraries and brute force."""

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import awkward, clashing, listed
from tokenizers import Tokenizer

from quire.llm.bpe import BpeCodec, BpeTransducer, encode_decode, encode_decode_digests, load_ranks
from quire.llm.packing import BestFit, WordTokenizer, document_pieces, pack_documents, pack_pieces
from quire.llm.token_counts import BYTE_SCORE, TrieCounter, count_tokens, piece_scores

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PARTS = ["a", "B", "the", "  ", " ", "\n", "\t", "'s", "'LL", "é", "É", "ß", "İ", "ion", "123", "!!", "...", "\xa0", "日本", "🙂", "\x1c", "\x85", "é", "x" * 40, "　", "aaaa", "<|endoftext|>", "<|ENDOFTEXT|>", "ing?", "٣", "ª", "\u200b"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "a" * 5000, "\n" * 300, " " * 300, "é" * 999]


def test_transducer_equals_the_library():
    ranks = load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = BpeCodec(ranks, P.PATTERN, memo=50, max_states=500)  # small tables are cleared on the way
    for text in random_texts(1500):
        ids = codec.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text
        assert "".join(codec.decode(ids, step=3)) == text


def test_transducer_on_small_vocabularies():
    rng = random.Random(5)
    for _ in range(30):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 20:  # a merge of two tokens, as in training
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            if len(a + b) < 9:
                ranks.setdefault(a + b, len(ranks))
        own = BpeTransducer(ranks)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert own.encode(word) == own.merge_all(word)


def test_codec_rows(spark):
    frame = awkward(spark)
    out = encode_decode(frame, RANKS, P.PATTERN).collect()
    expected = [(r.doc_id, r.text or "") for r in frame.collect()]
    assert sorted(map(str, [(r.doc_id, r.decoded) for r in out])) == sorted(map(str, expected))
    digests = encode_decode_digests(frame, RANKS, P.PATTERN)
    assert sorted(r.n_tokens for r in digests.collect()) == sorted(len(r.ids) for r in out)
    assert listed(encode_decode_digests(clashing(frame), RANKS, P.PATTERN)) == listed(digests)
    assert encode_decode_digests(frame.limit(0), RANKS, P.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    texts = random_texts(3000, 2)
    library = Tokenizer.from_file(WORDS)
    for text, packed, own in zip(texts, WordTokenizer(WORDS).packed(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, "<u4").tolist() == own.ids, text


def test_best_fit_matches_a_plain_search():
    rng = random.Random(3)
    for bound in (1, 3, 50):
        bins, free, made = BestFit(100, bound), {}, 0
        for _ in range(800):
            n = rng.choice([1, 5, 30, 60, 99, 100])
            at, offset = bins.place(n)
            fitting = [(f, b) for b, f in free.items() if f >= n]
            if fitting:
                assert free[at] == min(fitting)[0]
            else:
                assert at == made and offset == 0
                if n < 100 and len(free) >= bound:
                    gone = min(free.values())
                    free.pop(next(b for b in free if free[b] == gone and b not in bins.stacks[gone]))
                free[at] = 100
                made += 1
            assert offset == 100 - free[at]
            free[at] -= n
            if not free[at]:
                free.pop(at)
            assert bins.count == len(free) <= bound


def test_the_bound_on_open_bins_binds():
    rng = random.Random(11)
    lengths = [min(4096, int(rng.lognormvariate(6.4, 0.9)) + 1) for _ in range(20_000)]
    bins = BestFit()
    for n in lengths:
        bins.place(n)
        assert bins.count <= bins.open_bins
    assert bins.closed > 0 and bins.made <= 1.01 * -(-sum(lengths) // 4096)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark):
    frame = awkward(spark, [(100 + i, "word " * (i * 37 % 400), "en", "s", 1) for i in range(200)])
    rows = pack_documents(frame, WORDS, capacity=256).collect()
    used = check_packing(rows, 256)
    assert used <= 1.05 * sum(r.length for r in rows) / 256 + 1
    library = Tokenizer.from_file(WORDS)
    expected = []
    for r in frame.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected += [(r.doc_id, k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert pack_documents(frame.limit(0), WORDS).count() == 0
    assert pack_documents(clashing(frame), WORDS, capacity=256).count() == len(rows)
    ids = document_pieces(frame, WORDS, 256, with_ids=True)
    assert all(len(r.ids) == r.length for r in ids.collect())
    assert check_packing(pack_pieces(ids, 256, tasks=3, order=["doc_id", "piece", "ids_crc32"]).collect(), 256) >= used


def brute_count(scores, word):
    text, longest = "▁" + word, 32

    @cache
    def best(end):
        if not end:
            return 0, 0
        size = len(text[end - 1].encode())
        s, n = best(end - 1)
        options = [(s + BYTE_SCORE * size, -(n - -size))]
        for start in range(max(0, end - longest), end):
            if text[start:end] in scores:
                s, n = best(start)
                options.append((s + scores[text[start:end]], -(n + 1)))
        s, n = max(options)
        return s, -n

    return best(len(text))[1]


def test_prefixes_are_scored_once():
    counter = TrieCounter({"a": -1, "b": -2, "ab": -2, "▁": -1, "▁a": -3})
    counter.counts("abab abba")
    nodes = len(counter.best)
    assert nodes == 2 + 4 + 2  # root, its mark, one word, and two more characters
    counter.counts("abab ab abb")
    assert len(counter.best) == nodes


def test_trie_counts_match_brute_force(spark):
    scores = piece_scores(P.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    words = sorted({"".join(rng.choice(["the", "th", "ing", "a", "é", "🙂", "日", "x", "er", "."]) for _ in range(rng.randint(1, 12))) for _ in range(400)})
    for bound in (1_000_000, 60):
        counter = TrieCounter(scores, bound)
        assert all(counter.insert(w) == brute_count(scores, w) for w in words + words[:50])
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    frame = awkward(spark, [(50 + i, t, "en", "s", 1) for i, t in enumerate(texts)]).where("doc_id is null or doc_id <> 6")
    expected = sorted(str((r.doc_id, len((r.text or "").split()), sum(brute_count(scores, w) for w in (r.text or "").split()))) for r in frame.collect())
    out = count_tokens(frame, P.path("piece_bpe_32k.model"))
    assert sorted(str(tuple(r)) for r in out.collect()) == expected
    assert listed(count_tokens(clashing(frame), P.path("piece_bpe_32k.model"))) == listed(out)
    assert count_tokens(awkward(spark), P.path("piece_bpe_32k.model")).count() == awkward(spark).count()
    assert count_tokens(clashing(frame).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_bad_lengths_are_refused():
    with pytest.raises(ValueError):
        BestFit(10, 2).place(11)
