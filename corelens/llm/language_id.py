r"""Language identification: multinomial logistic regression on TF-IDF weights of hashed character n-grams.

A text becomes lower-case letters and their marks with single blanks in place of anything else; its 1- to 3-grams are hashed to BUCKETS.
Feature x_b is tf_b * idf_b over the sum of all tf * idf of the text, so any length gives the same scale. Weights are learnt by
follow-the-regularised-leader with elastic net (L1, L2), one pass over a document at a time, and a temperature fitted on
one fifth of the sample calibrates the probabilities.

Document frequencies come from every document that may be learnt from. The fit uses a bounded sample of them: at most
PER_LANGUAGE documents of each language, those with the smallest hash of the id, and of these the FIT_BYTES / languages first bytes of hash lists, at least one document
of each: every language is learnt, and what reaches the driver is bounded. Prediction reads every whole text; the table that goes to the tasks has BUCKETS x languages numbers.

Defined cases: a null text, or one without a letter (\p{L}; marks alone are none), is `und` with score 0; with no training rows every text is; repeated
documents give repeated, equal rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelens.llm.sampling import held_out, smallest_hashes
from corelens.session import bounded_batches, discard, written

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
PER_LANGUAGE, PASSES = 1_000, 4
#: Bytes of the sample's n-gram lists that the fit collects.
FIT_BYTES = 256 << 20
ALPHA, BETA, L1, L2 = 0.05, 1.0, 1e-4, 1e-4
SCALE = 20.0
UNKNOWN = "und"

_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
#: Odd multipliers of the n-gram hash.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Code points hashed at a time.
_BLOCK = 1 << 18


def buckets_of(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text, in no order that matters; empty without a letter."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not _LETTER.search(letters):
        return np.empty(0, np.uint32)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32)
    out, value = [], np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        value = (value[: len(codes) - n + 1] if n > 1 else value) * np.uint32(_MULTIPLIERS[0]) + codes[n - 1 :] * np.uint32(_MULTIPLIERS[1])
        out.append(((value ^ (value >> np.uint32(15))) * np.uint32(_MULTIPLIERS[2]) + np.uint32(n)) >> np.uint32(16))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    """table: per bucket the languages' weights times idf, and idf itself in the last column."""

    languages: list[str]
    table: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages) + 1)
        for at in range(0, len(buckets), _BLOCK):
            total += self.table.take(buckets[at : at + _BLOCK], axis=0).sum(axis=0, dtype=np.float64)
        return SCALE * total[:-1] / max(total[-1], 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets = buckets_of(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(buckets) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> LanguageModel:
    """rows: distinct buckets, their counts and the language of each sampled text, in a fixed order."""
    languages = sorted({lang for _, _, lang in rows})
    if not languages:
        return LanguageModel([])
    place = {lang: k for k, lang in enumerate(languages)}
    data = []
    for buckets, counts, lang in rows:
        if len(buckets):
            x = counts * idf[buckets]
            data.append((buckets, SCALE * x / max(x.sum(), 1e-12), place[lang]))
    order = np.random.default_rng(7).permutation(len(data))
    kept = [data[k] for j, k in enumerate(order) if j % 5] or data
    calibration = [data[k] for j, k in enumerate(order) if j % 5 == 0]
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= L1, 0.0, -(pull - np.sign(pull) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for buckets, x, label in kept:
            w = weights(buckets)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error[None, :]
            squared = g * g
            was = n[buckets]
            z[buckets] += g - (np.sqrt(was + squared) - np.sqrt(was)) / ALPHA * w
            n[buckets] = was + squared
    final = weights(slice(None))
    model = LanguageModel(languages, np.hstack([final * idf[:, None], idf[:, None]]).astype(np.float32))
    if calibration:
        logits, truth = np.array([x @ final[b] for b, x, _ in calibration]), np.array([label for _, _, label in calibration])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 61)), key=loss)
    return model


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; a task yields at most BUCKETS + 1 rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, seen = np.zeros(BUCKETS + 1, np.int64), 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[buckets_of(text)] = True
                here = np.flatnonzero(seen)
                n[here] += 1
                seen[here] = False
                total += 1
        n[BUCKETS] = total
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def train(docs: DataFrame) -> LanguageModel:
    """The model learnt from documents with a language that aren't held out."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    df, total = _document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    chosen = smallest_hashes(known.select("doc_id", "lang").distinct(), "doc_id", "lang", PER_LANGUAGE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.unique(buckets_of(t), return_counts=True) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in pairs], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in pairs], pa.binary())], names=["doc_id", "lang", "buckets", "counts"]
            )

    sampled = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(counted, "doc_id long, lang string, buckets binary, counts binary")
    sampled = written(sampled, "sample")
    share = FIT_BYTES // max(1, sampled.select("lang").distinct().count())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "buckets")
    bounded = sampled.withColumn("before", F.sum(F.octet_length("buckets") + F.octet_length("counts")).over(first.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < share)
    rows = sorted((r["doc_id"], r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in bounded.drop("before").collect())
    discard(sampled)
    return fit([(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(float), lang) for _, lang, b, c in rows], idf)


def language_id(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    bounded_batches(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return narrow.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
