import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelens.llm import suffix_dedup as sd


def naive(texts, length=400, least_words=0):
    """n_bytes, n_removed, n_spans, sha256 of each text, by all windows of `length` bytes."""
    counts = collections.Counter(t[a : a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if counts[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        for run in re.finditer(b"\1+", gone):
            if len(t[run.start() : run.end()].split()) < least_words:
                gone[run.start() : run.end()] = bytes(len(run[0]))
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [text(rng.randint(1, 300)) for _ in range(25)]
    out += [out[0], out[1], out[1]]
    passage = text(130)
    for n in (399, 400, 401, 450, 700):  # the same passage in many contexts, cut at several lengths
        part = passage.encode()[:n].decode("utf-8", "ignore")
        out += [f"{text(rng.randint(0, 40))} {part} {text(rng.randint(0, 40))}" for _ in range(3)]
    near = out[3] + out[4]
    for _ in range(6):
        words = near.split(" ")
        words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += ["a" * 1500, "a" * 700 + "b" * 500, "ab" * 400, "the same words " * 60, "xyz" * 300 + text(50), "\0" * 900, "\0" * 420 + "q" + "\0" * 380]
    out += ["", "short", text(80) + passage + passage + text(10)]
    return out


@pytest.mark.parametrize("seed,limit", [(1, 20_000), (2, 20_000), (3, 2), (4, 5)])
def test_matches_brute_force(spark, monkeypatch, seed, limit):
    texts = _corpus(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, lo int, h string")
    monkeypatch.setattr(sd.repeated_spans, "__defaults__", (sd.Shape(), limit))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df.repartition(3)).collect()}
    want = dict(enumerate(naive([t.encode() for t in texts])))
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert got == want


def test_edge_cases(spark):
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (None, "x" * 10), (5, long), (5, long), (6, long + " end"), (6, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in sd.dedup(df).collect())
    n = len(long)
    assert got == collections.Counter([(1, 0, 0), (2, 0, 0), (None, 10, 0), (5, n, n), (5, n, n), (6, n + 4, n), (6, 10, 0)])
    assert sd.dedup(df.limit(0)).collect() == []


def test_documents_keep_their_columns(spark):
    passage = "é" * 300
    df = spark.createDataFrame([(1, "a " + passage + " b", "en", 7), (2, "c " + passage + " d", None, 8), (3, None, "x", None)], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: tuple(r) for r in sd.dedup_documents(df).collect()}
    assert got == {1: (1, "ab", "en", 7), 2: (2, "cd", None, 8), 3: (3, "", "x", None)}


def test_periodic_text_is_settled_inside():
    text = b"ab" * 5000
    rows = list(sd._entries(1, 2, text, sd.parse([text])[0]))
    assert len(rows) < 20


def test_shorter_strings_and_least_words(spark):
    texts = _corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, words in ((200, 0), (200, 50), (64, 20)):
        want = {k: len(t.encode()) - n for k, (t, (_, n, _, _)) in enumerate(zip(texts, naive([t.encode() for t in texts], length, words)))}
        got = {r.doc_id: r.n_bytes - r.n_removed for r in sd._removed(df, False, length, words).collect()}
        assert got == want


@pytest.mark.parametrize("seed", range(30))
def test_corpus_order_of_pieces(seed):
    """Every window against every other, on pieces with few letters, repeats and cuts inside phrases."""
    rng = random.Random(seed)
    letters = [b"ab", b"\0a", b"abcdefgh", bytes(range(256))][seed % 4]
    base = [bytes(rng.choices(letters, k=rng.randint(40, 400))) for _ in range(4)]
    pieces = []
    for _ in range(30):
        x = b"".join(rng.choices(base, k=3))
        a = rng.randrange(len(x) // 2)
        pieces.append(x[a : a + rng.randint(70, 300)])
    length = rng.choice([16, 30, 64])
    first = np.array([rng.randint(0, (len(p) - length) // 2) if len(p) >= length else 0 for p in pieces])
    last = np.array([rng.randint(f, len(p) - length) if len(p) >= length else -1 for f, p in zip(first, pieces)])
    windows = [(k, a, pieces[k][a : a + length]) for k in range(len(pieces)) for a in range(first[k], last[k] + 1)]
    counts = collections.Counter(w for _, _, w in windows)
    piece, start = sd.repeated_windows(pieces, first, last, length)
    assert sorted(zip(piece.tolist(), start.tolist())) == [(k, a) for k, a, w in windows if counts[w] > 1]


def test_a_hot_core_is_split(spark):
    """A passage in very many contexts: no task gets more than the limit of pieces of a key, and the result is that of brute force."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(70))
    texts = [f"{word()} {word()} {passage} {word()} {word()}" for _ in range(120)] + [f"{word()} {word()} {word()} {passage[:420]} {word()}" for _ in range(60)]
    keyed = sd._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = collections.defaultdict(set)
    for r in sd.repeated_spans(keyed.select("doc_id", F.col("text").cast("string").alias("text")), core_limit=10).collect():
        got[r.doc_id] |= set(range(r.lo, r.hi + 1))
    raw = [t.encode() for t in texts]
    counts = collections.Counter(t[a : a + 400] for t in raw for a in range(len(t) - 399))
    assert got == {k: found for k, t in enumerate(raw) if (found := {a for a in range(len(t) - 399) if counts[t[a : a + 400]] > 1})}


@pytest.mark.parametrize("seed", [6, 7])
def test_passages_below_the_removed_length_are_counted(spark, tmp_path, seed):
    """The query removes by 400 bytes as ever and counts passages of 50 words that are shorter; both as brute force has them."""
    from corelens.llm import queries

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(55), prose(40)
    texts = _corpus(seed) + [f"{prose(20)} {passage} {prose(20)}" for _ in range(4)] + [f"{prose(20)} {line} {prose(20)}" for _ in range(4)] + [prose(60)]
    assert len(passage) < 400 and 200 < len(line)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, passage), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for _, t in rows]
    removed, counted = naive(raw), naive(raw, sd.PASSAGE_BYTES, sd.PASSAGE_WORDS)
    want = collections.Counter((k, *a, b[2], b[1]) for (k, _), a, b in zip(rows, removed, counted))
    out = queries.op1_suffix_array_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
    assert collections.Counter(map(tuple, out.collect())) == want
    planted, other = counted[len(texts) - 9 : len(texts) - 5], counted[len(texts) - 5 : len(texts)]
    assert all(n >= len(passage) and runs == 1 for _, n, runs, _ in planted) and not any(runs for _, _, runs, _ in other)


@pytest.mark.parametrize("limit", [2, 20_000])
def test_longer_spans_are_those_of_the_whole_texts(spark, limit):
    df = spark.createDataFrame(list(enumerate(_corpus(8))), "doc_id long, text string")
    starts = lambda spans: {(r.doc_id, a) for r in spans.collect() for a in range(r.lo, r.hi + 1)}
    shorter = sd.repeated_spans(df, sd.Shape(200))
    assert starts(sd.longer_spans(df, shorter, sd.Shape(200), sd.Shape(400), limit)) == starts(sd.repeated_spans(df))
