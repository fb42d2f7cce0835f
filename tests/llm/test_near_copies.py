"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np

from corelens.llm import near_copies
from corelens.operators.components import DisjointSets


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pairs_of_similarity_are_linked(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(2000)]
    texts = ["", None, "one two", "One  two"]
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join(words))
        for _ in range(3):  # a chain of copies, each with further words changed
            words = words[:]
            for _ in range(max(1, len(words) // 55)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (None, "only nameless"), (None, "only nameless")], "doc_id long, text string")
    sets, sets_of = DisjointSets(), [shingles(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets_of[a], sets_of[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            sets.union(a, b)
    want = {sets.find(a) for a in range(len(texts))}
    rows = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want)
    assert [r.text for r in rows if r.doc_id is None] == ["only nameless"]
    assert len(want) < len(texts) - 40


def test_a_group_of_variants(spark):
    """Many texts around one, not all of them alike: the components are those of all pairs, and a task gives no more links than connect them."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = rng.choices(vocabulary, k=150)
    texts = []
    for _ in range(120):
        words = base.copy()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    sets = DisjointSets()
    for a in range(len(texts)):
        sets.find(a)
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                sets.union(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.representatives(df).collect()) == sorted({sets.find(k) for k in range(len(texts))})
    signed = [near_copies.signature(t.encode()) for t in texts]
    sketch = np.frombuffer(b"".join(s for _, s, _ in signed), np.uint8).reshape(len(texts), -1)
    links = list(near_copies._bucket_links(list(range(len(texts))), np.arange(len(texts)), sketch, [t.encode() for t in texts]))
    assert len(links) == len(texts) - len({sets.find(k) for k in range(len(texts))})
