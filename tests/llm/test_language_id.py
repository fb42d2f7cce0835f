import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corelens.llm import language_id as lid
from corelens.llm.sampling import held_out

SYLLABLES = {"en": ["the", "and", "ing", "th", "er"], "de": ["der", "sch", "ung", "ü", "ein"], "xx": ["ко", "ра", "то"]}


def _docs(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((k, text + rng.choice(["", "!!", " 123"]), lang, "s", 0.5))
    rows += [(9001, None, "en", "s", None), (9002, "", None, "s", None), (9003, "12 ... §§ 💡", "en", "s", None), (9004, "der schung " * 30_000, None, "s", None), (None, "the ing and", "de", "s", None), (7, rows[7][1], rows[7][2], "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), rows


def test_predictions(spark):
    df, rows = _docs(spark)
    out = lid.language_id(df).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 9000}
    tested = [r for r in out if r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested if r.held_out]) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in {*SYLLABLES, "und"} and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id is None or r.doc_id > 9000} == {9001: "und", 9002: "und", 9003: "und", 9004: "de", None: "en"}
    assert sorted(map(repr, out)) == sorted(map(repr, lid.language_id(df.repartition(5)).collect()))


def test_learns_only_from_what_it_may(spark):
    df, _ = _docs(spark)
    changed = df.withColumns({"lang": F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("other")})
    a, b = lid.train(df), lid.train(changed)
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    idf = np.ones(lid.BUCKETS)
    rows = []
    sample = lambda lang: np.sort(rng.choice(200, 60, replace=False)) + 200 * lang
    for _ in range(800):  # 20 % of labels are noise
        lang = int(rng.integers(2))
        label = lang if rng.random() < 0.8 else 1 - lang
        rows.append((sample(lang), np.ones(60), "ab"[label]))
    model = lid.fit(rows, idf)
    scores = [np.exp(model.logits(sample(k % 2)) / model.temperature) for k in range(200)]
    assert np.mean([s.argmax() == k % 2 for k, s in enumerate(scores)]) > 0.95
    assert abs(np.mean([s.max() / s.sum() for s in scores]) - 0.8) < 0.08


def test_elastic_net_gives_zeros():
    rows = [(np.array([k % 2, 100 + k]), np.array([50.0, 1.0]), "ab"[k % 2]) for k in range(200)]
    model = lid.fit(rows, np.ones(lid.BUCKETS))
    assert (model.table[5_000:, :-1] == 0).all() and (model.table[:2, :-1] != 0).all()


def test_empty_and_unlabelled(spark):
    df, _ = _docs(spark, 20)
    assert lid.language_id(df.limit(0)).collect() == []
    assert {(r.lang_pred, r.score) for r in lid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_marks_alone_are_undetermined(spark):
    df, _ = _docs(spark)
    model = lid.train(df)
    assert [model.predict(t)[0] for t in ("\u0301", "\u0301 \u0308!", "der schung\u0308")] == ["und", "und", "de"]


def test_every_language_is_learnt(spark, monkeypatch):
    """Rare languages, and a collected sample below one text's size for each of them."""
    rows = [(k, " ".join([f"{chr(0x4E00 + 20 * (k % 240))}{chr(0x4E00 + 20 * (k % 240) + k % 7)}"] * 9), f"l{k % 240:03}") for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(lid.train(df).languages) == 240
    monkeypatch.setattr(lid, "FIT_BYTES", 240)
    assert len(lid.train(df).languages) == 240
