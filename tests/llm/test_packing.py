import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corelens.llm import packing

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_ids(text):
    assert packing.token_ids(text).tolist() == [*REFERENCE.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "<|", "endoftext", "|>", "é\n"]), max_size=12))
def test_special_strings_are_those_of_the_library(parts):
    text = "".join(parts)
    assert packing.token_ids(text).tolist() == [*REFERENCE.encode(text, add_special_tokens=False).ids, 0]


def _check(rows, texts):
    """Every id in exactly one piece, sequences gapless, of 1024 or a power of two."""
    ids = {k: packing.token_ids(t) for k, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
    assert pieces.keys() == texts.keys()
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    return pieces, ids


def test_round_trip(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = {k: " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 50, 400, 900]))) for k in range(3000)}
    texts |= {9000: None, 9001: "", 9002: "long " * 40_000}
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in texts.items()], "doc_id long, text string, length int, h string")
    pieces, ids = _check(packing.packed(df).collect(), texts)
    for k, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])


@pytest.mark.parametrize("partitions", [1, 64, 211])
def test_ids_do_not_depend_on_partitions(spark, partitions):
    """Sequences stay whole, and the same, without adaptive execution and whatever coalesces the result."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = {k: " ".join(rng.choices(vocabulary, k=rng.choice([1, 50, 300]))) for k in range(600)}
    texts |= {k: "the same copy" for k in range(600, 900)} | {900: None, 901: "word" * 300_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7, "doc_id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        rows = packing.packed(df, part_bytes=20_000).coalesce(3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _check(rows, texts)
    assert len({r.sequence_id >> 32 for r in rows}) > 10
    found = sorted((r.sequence_id, r.offset, r.doc_id, r.start) for r in rows)
    assert _seen.setdefault("rows", found) == found


_seen = {}


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id")], "doc_id long, text string")
    rows = packing.packed(df).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * len(packing.token_ids("same text"))
    assert sum(r.length for r in rows if r.doc_id is None) == len(packing.token_ids("no id"))
    assert packing.packed(df.limit(0)).collect() == []


def test_neighbours_share_words():
    rng = random.Random(5)
    topics = [["".join(rng.choices("abcdefghijkl", k=7)) for _ in range(30)] for _ in range(10)]
    texts = [" ".join(rng.choices(topics[k % 10], k=40)).encode() for k in range(200)]
    order = packing.reading_order(texts, [100] * 200, 0)
    assert sorted(k for k, _ in order) == list(range(200))
    assert np.mean([k % 10 == seed % 10 for k, seed in order]) > 0.9


def test_scores_are_bm25():
    texts = [b"a b b c", b"b c", b"c d e f", b""]
    index = packing.ShardIndex(texts)
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / 4
    df = collections.Counter(w for ws in words for w in set(ws))
    want = np.zeros(4)
    for term in {w for w in words[0] if df[w] > 1}:
        idf = np.log1p((4 - df[term] + 0.5) / (df[term] + 0.5))
        for k, ws in enumerate(words):
            tf = ws.count(term)
            want[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) if tf else 0
    assert np.allclose(index.scores(0), want)


def test_long_texts_are_scored_by_all_words():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(600)]
    words = [rng.choices(vocabulary, k=rng.randint(200, 600)) for _ in range(30)] + [["alone"], []]
    index = packing.ShardIndex([" ".join(ws).encode() for ws in words])
    counts, n = [collections.Counter(ws) for ws in words], len(words)
    mean = sum(map(len, words)) / n
    df = collections.Counter(w for c in counts for w in c)
    for seed in range(n):
        shared = [w for w in counts[seed] if df[w] > 1]
        assert len(shared) > 100 or seed >= 30
        want = [sum(np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in shared) for ws, c in zip(words, counts)]
        assert np.allclose(index.scores(seed), want)


def _greedy(texts, sizes, filled):
    """The fill order by definition: BM25 over all pairs, the best unused neighbour of the window's seed, ties by position."""
    words = [t.split() for t in texts]
    n, mean = len(texts), max(1.0, sum(map(len, words)) / len(texts))
    df = collections.Counter(w for ws in words for w in set(ws))

    def score(a, b):
        out = 0.0
        for w in set(words[a]):
            tf = words[b].count(w)
            if tf and df[w] > 1:
                out += np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[b]) / mean))
        return round(out, 9)

    order, seed, at = [], None, filled % 1024
    unused = list(range(n))
    while unused:
        best = max(unused, key=lambda k: (score(seed, k), -k)) if seed is not None else unused[0]
        if seed is not None and not score(seed, best):
            best = unused[0]
        unused.remove(best)
        order.append(best)
        before, at = seed, at + sizes[best]
        if before is None or at >= 1024:
            seed, at = best, at % 1024
    return order


@pytest.mark.parametrize("seed", range(6))
def test_fill_order_matches_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 20]))) for _ in range(40)]
    sizes = [rng.choice([1, 100, 700, 1024, 3000]) for _ in texts]
    got = packing.reading_order([t.encode() for t in texts], sizes, 17)
    assert [k for k, _ in got] == _greedy(texts, sizes, 17)


def test_parts():
    weights = np.array([0, 5, 3, 0, 50, 1, 9, 10, 2])
    first, parts = packing.parts_of(weights, 10)
    assert parts.tolist() == [1, 1, 1, 1, 5, 1, 1, 1, 1]
    assert [(k, int(first[k])) for k in np.flatnonzero(weights)] == [(1, 0), (2, 0), (4, 1), (5, 6), (6, 6), (7, 7), (8, 8)]


def test_related_documents_share_a_part():
    rng = random.Random(2)
    topics = [["".join(rng.choices("abcdefghijkl", k=7)) for _ in range(40)] for _ in range(50)]
    texts = [" ".join(rng.choices(topics[k % 50], k=150)) for k in range(2000)]
    keys = packing.lexical_keys(*packing.word_hashes([t.encode() for t in texts])).tolist()
    order = sorted(range(2000), key=lambda k: keys[k])
    assert np.mean([a % 50 == b % 50 for a, b in zip(order, order[1:])]) > 0.8  # by chance 0.02


def test_long_text_without_white_space(spark):
    texts = {1: "x" * 200_000, 2: "é" * 70_000}
    _check(packing.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_corpus_counts(spark):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choices(["Aa", "bb", "cc", "é", "dd"], k=rng.randint(0, 9))) for k in range(200)} | {500: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text")
    counts = packing.corpus_counts(df.repartition(5))
    words = [(t or "").replace("A", "a").split() for t in texts.values()]
    assert (counts.documents, counts.words) == (201, sum(map(len, words)))
    for w in ("aa", "bb", "cc", "é", "dd"):
        assert counts.df[packing.word_hashes([w.encode()])[0][0] % packing.WORD_BUCKETS] == sum(w in ws for ws in words)


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others differ; chunks are cut between words."""
    rng = random.Random(8)
    texts = [b"", b" \n", b"one", "É é A a\x0bb\x1cc".encode(), b"x" * 5000] + [b" ".join(rng.choices([b"aa", b"AA", b"ab", b"a", b"longer" * 9], k=rng.randint(0, 80))) + rng.choice([b"", b"  "]) for _ in range(60)]
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = [t.translate(lower).split() for t in texts]
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(packing, "_CHUNK", chunk)
        hashes, counts = packing.word_hashes(texts)
        assert counts.tolist() == [len(w) for w in words]
        of = dict(zip((w for ws in words for w in ws), hashes.tolist()))
        assert hashes.tolist() == [of[w] for ws in words for w in ws] and len(set(of.values())) == len(of) and max(of.values()) < 1 << 39
    keys = packing.lexical_keys(hashes, counts)
    assert keys[:2].tolist() == [[0] * 3] * 2 and (keys[2:5] > 0).all()
    assert keys.tolist() == [packing.lexical_keys(*packing.word_hashes([t])).tolist()[0] for t in texts]
