"""Quality by importance resampling.

Two bags of hashed word unigrams and bigrams are estimated: the target's, from texts labelled good, and the raw corpus's, from
all documents. A document's log weight is the sum over its n-grams of log p_target - log p_raw; adding Gumbel noise and taking
the k largest keys samples k documents without replacement in proportion to their weights. The noise is a function of the
document's id and text, so reruns agree.

The target bag uses a bounded sample of the labelled rows (TARGET_ROWS, those with the smallest hash of the id, never a held-out row); the raw bag counts every
document. The k-th largest key is found exactly by counting 16 bits of the keys at a time, so nothing is sorted and at most 65,536
counts reach the driver; a tie at the k-th key is kept whole.

Defined cases: a null or empty text has no n-grams and log weight 0; without good labels both bags are alike and weights
are about 0; equal rows have equal keys; null labels are no labels; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.llm.sampling import held_out, smallest_hashes
from corelens.session import bounded_batches, written

BUCKETS = 10_000  # of unigrams, and as many of bigrams
TARGET_ROWS, SMOOTHING = 20_000, 1.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: bytes | None) -> np.ndarray:
    """Buckets of a text's unigrams (below BUCKETS) and bigrams (from BUCKETS on)."""
    words = (text or b"").translate(_LOWER).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pair = (h[:-1] * _MIX + h[1:]) * _MIX >> np.uint64(20)
    return np.concatenate([h % np.uint64(BUCKETS), pair % np.uint64(BUCKETS) + np.uint64(BUCKETS)]).astype(np.int64)


def _bag(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets; a task yields a row for each bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(ngrams(text), minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(2 * BUCKETS)
    for r in texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _log_shares(bag: np.ndarray) -> np.ndarray:
    halves = bag.reshape(2, BUCKETS) + SMOOTHING
    return np.log(halves / halves.sum(axis=1, keepdims=True)).ravel()


def target_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("one")).distinct()
    chosen = smallest_hashes(good, "doc_id", "one", TARGET_ROWS).select("doc_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("text")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles x."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, by four counts of 16 bits each; None if there are fewer than k."""
    if k <= 0:
        return None
    value, low = 0, keys.select((F.col(column)).alias("x"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("x", shift).bitwiseAND(F.lit(0xFFFF).cast("long")) if shift < 48 else F.shiftright("x", 48)
        counts = sorted(((r["d"], r["n"]) for r in low.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return None
        value = value << 16 | d if shift < 48 else d
        low = low.where(digit == d)
    return value


def log_weights(docs: DataFrame, target: np.ndarray, raw: np.ndarray) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel and sort_key of every row."""
    ratio = docs.sparkSession.sparkContext.broadcast(_log_shares(target) - _log_shares(raw))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t) for t in batch.column(1).to_pylist()]
            weight = np.array([ratio.value[x].sum() for x in found], float)
            noise = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)
            gumbel = -np.log(-np.log((noise.astype(float) + 0.5) / 2.0**53))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(weight), pa.array(gumbel), pa.array(_ordered(weight + gumbel))], names=["doc_id", "n_ngrams", "log_weight", "gumbel", "sort_key"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit("gumbel"), "doc_id", "text").alias("h"))
    return narrow.mapInArrow(scored, "doc_id long, n_ngrams long, log_weight double, gumbel double, sort_key long")


def importance_resampling(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel and selected (among the k largest keys) of every row.

    k: documents to sample; by default the share of good rows among the labels that aren't held out, of all documents.
    """
    bounded_batches(docs.sparkSession)
    keys = written(log_weights(docs, _bag(target_texts(docs, labels)), _bag(docs)), "keys")
    if k is None:
        share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
        k = math.ceil(keys.count() * (1.0 if share is None else share))
    least = kth_largest(keys, "sort_key", k)
    selected = F.lit(k > 0) if least is None else F.col("sort_key") >= F.lit(least)
    return keys.select("doc_id", "n_ngrams", "log_weight", "gumbel", selected.alias("selected"))
