"""Toxicity: logistic regression with a counterfactual penalty on identity terms.

Features are words and word stems (their first 4 to 7 letters). Each has two weights, one for its presence and one for its rate, RATE times the
occurrences over the words plus SMOOTH: some words tell by standing anywhere, others by standing often. The model keeps the MAX_FEATURES that speak for label 1 most clearly
(likelihood ratio of texts with and without them, counted on the executors). Every sentence of a labelled text that names an identity term also enters as counterfactuals - each term
swapped for every other of its group, and each term left out - and the loss adds LAMBDA times the mean squared change of the
sentence's logit, so a neutral mention of a group doesn't raise the score. Labels are those of whole documents; a sentence has its document's.

The fit uses a bounded sample: at most PER_CLASS[label] labelled rows of either label, those with the smallest hash
of the id, never a held-out row. Scoring reads every whole text; the model that goes to the tasks has MAX_FEATURES weights at most.

Defined cases: a null or empty text has no features and gets the model's intercept; with no training rows, or rows of
one label only, all scores are the smoothed share of label 1 (0 without rows); a document with several labels counts as toxic if any is
1; repeated documents give repeated, equal rows; null labels are no labels; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.llm.sampling import held_out, smallest_hashes
from corelens.session import bounded_batches, discard, written

PER_CLASS = {1: 4_000, 0: 8_000}
MAX_FEATURES, LEAST_ROWS, LEAST_GAIN, STEMS = 4_096, 3, 8.0, (4, 5, 6, 7)
RATE, SMOOTH = 50.0, 30
#: Files, and tasks, of the bounded sample.
SAMPLE_PARTS = 12
LAMBDA, RIDGE, ROUNDS, THRESHOLD = 4.0, 1e-4, 600, 0.3

#: Identity terms by group, in English, German, French and Spanish. A term stands in one group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("discapacitados", "ciegos", "sordos"),
)
_GROUP = {t: g for g in IDENTITY for t in g}
_WORD, _SENTENCE = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def features_of(words: Counter[str]) -> Counter[str]:
    out = Counter(words)
    for n in STEMS:
        for w, k in words.items():
            if len(w) >= n:
                out[w[:n] + "*"] += k
    return out


def rates(words: Counter[str], wanted) -> dict[str, float]:
    """Rates of the features of a text that are in `wanted`."""
    found: dict[str, int] = {}
    for w, k in words.items():
        if w in wanted:
            found[w] = found.get(w, 0) + k
        for n in STEMS:
            if len(w) >= n and (stem := w[:n] + "*") in wanted:
                found[stem] = found.get(stem, 0) + k
    scale = RATE / (words.total() + SMOOTH)
    return {f: k * scale for f, k in found.items()}


@dataclass
class ToxicityModel:
    """weights: of a feature's presence and of its rate."""

    bias: float = -30.0
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found = rates(words_of(text), self.weights)
        z = self.bias + math.fsum(self.weights[f][0] + self.weights[f][1] * x for f, x in found.items())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def counterfactuals(words: Counter[str]) -> list[Counter[str]]:
    """For each identity term in words: the words with that term swapped for every other of its group, and without it."""
    out = []
    for term in sorted(words.keys() & _GROUP.keys()):
        rest = Counter({w: k for w, k in words.items() if w != term})
        for other in _GROUP[term]:
            if other != term:
                swapped = rest.copy()
                swapped[other] += words[term]
                out.append(swapped)
        out.append(rest)
    return out


def sentence_pairs(text: str | None) -> list[tuple[Counter[str], Counter[str]]]:
    """(words, words of a counterfactual) of every sentence that names an identity term."""
    if not words_of(text).keys() & _GROUP.keys():
        return []
    sentences = [words_of(x) for x in _SENTENCE.findall(text)]
    return [(words, other) for words in sentences for other in counterfactuals(words)]


@dataclass
class Example:
    """A labelled text as numbers of selected features and their rates; changed: the same for pairs of a sentence and a counterfactual."""

    label: int
    features: tuple[list[int], list[float]]
    changed: list[tuple] = field(default_factory=list)


def example_of(text: str | None, label: int, place: dict[str, int]) -> Example:
    def numbered(w: Counter[str]) -> tuple[list[int], list[float]]:
        found = sorted((place[f], x) for f, x in rates(w, place).items())
        return [i for i, _ in found], [x for _, x in found]

    return Example(label, numbered(words_of(text)), [(numbered(a), numbered(b)) for a, b in sentence_pairs(text)])


def fit(examples: list[Example], features: list[str]) -> ToxicityModel:
    n = [sum(x.label == k for x in examples) for k in (0, 1)]
    if not examples:
        return ToxicityModel()
    if 0 in n:
        return ToxicityModel(math.log((n[1] + 0.5) / (n[0] + 0.5)))

    def sparse(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, cols = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]), np.array([i for ids, _ in rows for i in ids], np.int64)
        xs = np.array([x for _, xs in rows for x in xs], float)
        return np.concatenate([at, at]), np.concatenate([cols, cols + len(features)]), np.concatenate([np.ones(len(xs)), xs])

    at, cols, xs = sparse([x.features for x in examples])
    y = np.array([x.label for x in examples], float)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # either label weighs half
    pairs = [pair for x in examples for pair in x.changed]
    a_at, a_cols, a_xs = sparse([a for a, _ in pairs])
    b_at, b_cols, b_xs = sparse([b for _, b in pairs])
    d_at, d_cols, d_xs = np.concatenate([a_at, b_at]), np.concatenate([a_cols, b_cols]), np.concatenate([a_xs, -b_xs])
    size = 2 * len(features)
    w, bias = np.zeros(size), 0.0
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(at, w[cols] * xs, len(examples)) + bias
        pull = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(cols, pull[at] * xs, size) + RIDGE * w
        if pairs:
            change = np.bincount(d_at, w[d_cols] * d_xs, len(pairs)) / len(pairs)
            g += 2 * LAMBDA * np.bincount(d_cols, change[d_at] * d_xs, size)
        g = np.append(g, pull.sum())
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:size], bias - move[-1]
    both = w.reshape(2, -1).T
    return ToxicityModel(float(bias), {f: (float(a), float(b)) for f, (a, b) in zip(features, both, strict=True) if abs(a) + abs(b) > 1e-6})


def sampled(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> DataFrame:
    """(doc_id, label, text): the bounded sample of labelled rows, one for each document."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = smallest_hashes(known, "doc_id", "label", per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(SAMPLE_PARTS), "sample")


def selected_features(sample: DataFrame) -> list[str]:
    """The MAX_FEATURES features with the largest likelihood ratio among those that texts of label 1 have more often, and all identity terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[label].update(features_of(words_of(text)).keys())
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[0][f] for f in names], pa.int64()), pa.array([by[1][f] for f in names], pa.int64())], names=["feature", "n0", "n1"])

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    counts = sample.select("label", "text").mapInArrow(counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    have, gain = F.col("n0") + F.col("n1"), F.lit(0.0)
    for seen, total in (("n0", n0), ("n1", n1)):
        for part, whole in ((F.col(seen), have), (total - F.col(seen), n0 + n1 - have)):
            gain = gain + F.when(part > 0, 2 * part * F.log(part / (whole * (total / (n0 + n1))))).otherwise(0.0)
    speaking = counts.where((have >= LEAST_ROWS) & (F.col("n1") * n0 > F.col("n0") * n1)).select("feature", F.round(gain, 9).alias("gain"))
    best = speaking.where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES).collect()
    return sorted({r["feature"] for r in best} | _GROUP.keys())


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> ToxicityModel:
    bounded_batches(docs.sparkSession)
    sample = sampled(docs, labels, per_class)
    features = selected_features(sample)
    place = {f: k for k, f in enumerate(features)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [example_of(t, label, place) for label, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            flat = [[x.features, *(half for pair in x.changed for half in pair)] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[i for i, _ in x] for x in flat], pa.list_(pa.list_(pa.int32()))), pa.array([[v for _, v in x] for x in flat], pa.list_(pa.list_(pa.float64())))], names=["doc_id", "label", "ids", "rates"]
            )

    rows = sample.mapInArrow(numbered, "doc_id long, label int, ids array<array<int>>, rates array<array<double>>").collect()
    examples = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own, *others = zip(r["ids"], r["rates"], strict=True)
        examples.append(Example(r["label"], own, list(zip(others[::2], others[1::2], strict=True))))
    discard(sample)
    return fit(examples, features)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, after the columns named in extra."""
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t) for t in batch.column("text").to_pylist()]
            rest = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32())], names=[*names, "score", "predicted"])

    narrow = docs.select(*extra, F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(scored, kinds + ", score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity_scores(docs, train(docs, labels))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
