import math
import random

import numpy as np
from pyspark.sql import functions as F

from corelens.llm import resampling as rs
from corelens.llm.sampling import held_out


def _tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        good = k % 4 > 0
        words = rng.choices(["alpha", "beta", "gamma", "delta"] if good else ["buy", "now", "$$$", "click"], k=rng.randint(1, 60))
        docs.append((k, " ".join(words), 7, "x"))
        if k % 2:
            labels.append((k, int(good), 0))
    docs += [(9001, None, 7, "x"), (9002, "", 7, "x"), (9003, "buy now " * 20_000, 7, "x"), (None, "alpha beta", 7, "x"), (5, docs[5][1], 7, "x")]
    labels += [(1, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, selected int, gumbel string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling(spark):
    docs, labels = _tables(spark)
    out = rs.importance_resampling(docs, labels, 250).collect()
    assert len(out) == docs.count()
    keys = sorted((r.log_weight + r.gumbel for r in out), reverse=True)
    for r in out:
        assert r.selected == (r.log_weight + r.gumbel >= keys[249]) and math.isfinite(r.gumbel)
        if r.doc_id is not None and r.doc_id < 400 and (r.n_ngrams > 60 or r.doc_id % 4 == 0):
            assert r.selected == (r.doc_id % 4 > 0)
        if r.doc_id in (9001, 9002):
            assert r.log_weight == 0 and r.n_ngrams == 0
    again = rs.importance_resampling(docs.repartition(5), labels, 250).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_weights_by_definition(spark):
    docs, labels = _tables(spark)
    target, raw = rs._bag(rs.target_texts(docs, labels)), rs._bag(docs)
    texts = [t.encode() if t else None for t in (r.text for r in docs.collect())]
    want = np.zeros(2 * rs.BUCKETS)
    for t in texts:
        np.add.at(want, rs.ngrams(t), 1)
    assert np.array_equal(raw, want) and 0 < target.sum() < raw.sum()
    ratio = rs._log_shares(target) - rs._log_shares(raw)
    rows = {r.doc_id: r.log_weight for r in rs.log_weights(docs, target, raw).collect()}
    for r in docs.where("doc_id < 50").collect():
        assert abs(rows[r.doc_id] - sum(ratio[b] for b in rs.ngrams(r.text.encode()))) < 1e-9


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 1, rng.randint(-(1 << 62), 1 << 62), rng.randint(-70_000, 70_000)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 77, 250, 499, 500):
        assert rs.kth_largest(df, "k", k) == ordered[k - 1]
    assert rs.kth_largest(df, "k", 501) is None and rs.kth_largest(df, "k", 0) is None


def test_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf])
    y = rs._ordered(x)
    assert (np.diff(y) >= 0).all() and y[3] == y[4]


def test_k_from_labels_and_empty(spark):
    docs, labels = _tables(spark)
    share = labels.agg(F.avg("quality")).first()[0]
    assert rs.importance_resampling(docs, labels).where("selected").count() >= math.ceil(share * docs.count())
    bad = docs.where(held_out(F.col("doc_id"))).select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    assert bad.count() > 50 and rs.importance_resampling(docs, labels.unionByName(bad)).where("selected").count() == rs.importance_resampling(docs, labels).where("selected").count()
    assert rs.importance_resampling(docs.limit(0), labels).collect() == []
    assert rs.importance_resampling(docs, labels.limit(0)).where("selected").count() == docs.count()
    assert rs.importance_resampling(docs, labels, 0).where("selected").count() == 0
