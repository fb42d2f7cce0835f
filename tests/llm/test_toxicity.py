import math
import random
import zlib

from corelens.llm import toxicity


def _tables(spark, seed=1, n=600):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 80)) + (rng.sample(["vile", "hateful", "nastyish", "nastyest"], 2) if toxic else [])
        if toxic and k % 10 == 0 or k % 25 == 1:
            text.append("muslim")  # named in toxic texts more often than in others
        rng.shuffle(text)
        docs.append((k, " ".join(text), "x", 1.0))
        labels.append((k, 1, int(toxic)))
    docs += [(9001, None, "x", None), (9002, "", "x", None), (9003, "vile hateful " + "word " * 30_000, "x", None), (None, "vile and hateful", "x", None), (3, docs[3][1], "x", None)]
    labels += [(3, 1, 0), (3, 1, None), (None, 0, 1), (4, 0, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark):
    docs, labels = _tables(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id in truth:
            assert r.predicted == truth[r.doc_id], r
    assert {r.doc_id: r.predicted for r in rows if r.doc_id in (9001, 9002, 9003, None)} == {9001: 0, 9002: 0, 9003: 1, None: 1}
    assert sorted(map(repr, rows)) == sorted(map(repr, toxicity.toxicity(docs.repartition(5), labels).collect()))


def test_training_ignores_held_out_rows(spark):
    docs, labels = _tables(spark)
    model = toxicity.train(docs, labels)
    from pyspark.sql import functions as F

    from corelens.llm.sampling import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, flipped).weights == model.weights


def test_counterfactual_penalty(spark, monkeypatch):
    docs, labels = _tables(spark)
    logit = lambda m, t: math.log(m.score(t) / (1 - m.score(t)))
    gap = lambda m: abs(logit(m, "they are muslim") - logit(m, "they are hindu"))
    fair = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "LAMBDA", 0.0)
    free = toxicity.train(docs, labels)
    assert gap(fair) < 0.25 * gap(free)
    assert fair.score("they are muslim") < 0.3


def test_empty(spark):
    docs, labels = _tables(spark)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {toxicity.ToxicityModel().score("")}
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect())


def test_without_toxic_keeps_columns(spark):
    docs, labels = _tables(spark)
    kept = toxicity.without_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    assert kept.where("text like '%hateful%'").count() == 0
    assert kept.where("doc_id = 9001 or doc_id = 9002").count() == 2


def test_sentences_are_swapped():
    pairs = toxicity.sentence_pairs("Plain words. The women met.\nUne femme lit! nobody")
    assert {tuple(sorted(a)) for a, _ in pairs} == {("met", "the", "women"), ("femme", "lit", "une")}
    assert [tuple(sorted(b)) for a, b in pairs if "met" in a] == [("men", "met", "the"), ("girls", "met", "the"), ("boys", "met", "the"), ("met", "the", "transgender"), ("met", "the")]
    assert sum("femme" in a for a, _ in pairs) == 4 and toxicity.sentence_pairs(None) == toxicity.sentence_pairs("no term") == []
    assert len(toxicity._GROUP) == sum(map(len, toxicity.IDENTITY))
