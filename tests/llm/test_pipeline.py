"""The pipeline's stages against brute force on a small corpus."""

import collections
import importlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
from test_suffix_dedup import naive as naive_dedup  # noqa: E402

from corelens.llm import mixing, packing  # noqa: E402
from corelens.operators.components import DisjointSets  # noqa: E402
from corelens.session import written  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, shorter, line = prose(90), prose(55), prose(30)
    docs = []
    for k in range(400):
        text = prose(rng.randint(20, 300))
        if k % 10 == 0:
            words = text.split()
            for _ in range(3 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "hateful", "loathsome"]))
            text = " ".join(words)
        elif k % 17 == 0:
            text = prose(60) + " " + passage + " " + prose(60)
        elif k % 23 == 0:
            text = prose(60) + " " + shorter + " " + prose(60)
        elif k % 19 == 0:
            text = prose(60) + "\n" + line + "\n" + prose(60)
        docs.append((k, text, "en", f"s{k % 4}" if k % 3 else "hot", len(text)))
    for k, of in ((400, 1), (401, 1), (402, 2), (403, 3)):  # copies, exact and but for a word
        words = docs[of][1].split()
        if k >= 402:
            words[5] = "changed"
        docs.append((k, " ".join(words), "en", "hot", 0))
    docs += [(404, "", None, None, 0), (405, None, None, "s1", None)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{where}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"file://{where}/labels.parquet")
    return f"file://{where}", docs, (passage, shorter, line)


@pytest.fixture(scope="module")
def stages(spark, corpus):
    """Rows in and out of every stage."""
    docs, out = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = written(stage(spark, docs, corpus[0]), name)
        if k < 4:
            assert now.columns == docs.columns
        out.append((name, docs.collect(), now.collect()))
        docs = now
    return out


def test_order(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mix", "packing"]


def test_toxic_documents_go(stages):
    _, before, after = stages[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {k for k in range(400) if k % 10 == 0}


def test_one_of_each_group_stays(stages):
    """Groups by the Jaccard similarity of five-word shingles, 0.8 or more, over all pairs."""
    _, before, after = stages[1]
    shingles = {}
    for r in before:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split()
        shingles[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets = DisjointSets()
    for a, x in shingles.items():
        sets.find(a)
        for b, y in shingles.items():
            if a < b and (len(x & y) >= 0.8 * len(x | y)):
                sets.union(a, b)
    assert sorted(r.doc_id for r in after) == sorted({sets.find(a) for a in shingles})
    assert {400, 401, 405} & {r.doc_id for r in after} == set()


def test_passages_go_and_lines_stay(stages, corpus):
    _, before, after = stages[2]
    passage, shorter, line = corpus[2]
    assert 200 < len(shorter) < 400 < len(passage)
    held = lambda rows, text: {r.doc_id for r in rows if text in (r.text or "")}
    assert len(held(before, passage)) > 5 and len(held(before, shorter)) > 5 and not held(after, passage) | held(after, shorter)
    assert len(held(before, line)) > 5 and held(after, line) == held(before, line)
    touched = held(before, passage) | held(before, shorter)
    texts = {r.doc_id: r.text or "" for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if r.doc_id not in touched)


def test_repeats_are_cut(stages):
    _, before, after = stages[2]
    texts = [(r.text or "").encode() for r in before]
    want = {}
    for r, t, (_, gone, _, _) in zip(before, texts, naive_dedup(texts, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)):
        want[r.doc_id] = len(t) - gone
    assert {r.doc_id: len(r.text.encode()) for r in after} == want and sum(want.values()) < sum(map(len, texts))
    assert all(r.n_chars == len(r.text) for r in after)


def test_sources_are_mixed(stages):
    _, before, after = stages[3]
    size = lambda rows: {s: sum(len(WORD.findall(r.text or "")) for r in rows if r.source == s) for s in {r.source for r in rows}}
    was, now = size(before), size(after)
    order = sorted(was, key=lambda s: (s is None, s or ""))
    for s, want in zip(order, mixing.targets([was[s] for s in order])):
        assert abs(now.get(s, 0) - want) <= 5
    copies = collections.Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3


def test_everything_is_packed(stages):
    _, before, after = stages[4]
    tokens = collections.Counter()
    for r in before:
        tokens[r.doc_id] += len(packing.token_ids(r.text))
    got = collections.Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == tokens


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_module_imports_without_guards():
    source = Path(corpus_pipeline.__file__).read_text()
    assert "try:" not in source and importlib.import_module("corpus_pipeline") is corpus_pipeline


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).collect() == []
