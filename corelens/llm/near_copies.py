"""Near copies: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more.

Candidates come from SimHash balls (`simhash.fingerprint_links` over fingerprints of the same shingles). A ball of 3 bits holds few of the pairs wanted: at 0.8 two
fingerprints differ in about 10 of 64 bits, and a ball of 16 bits, which would hold them, has billions of variants within half its radius.
What the balls can't reach is found by MinHash: BANDS keys of ROWS minima each, and texts that share a key are compared. A pair of similarity s shares none with probability
(1 - s**ROWS)**BANDS: 3e-6 at 0.8, less above. What is linked is verified by the Jaccard similarity of the whole texts.

Comparing all pairs of a crowd isn't needed to connect it. First every text is compared with the smallest that a ball or bucket offers it, then, where that leaves
the two in different components, with the smallest of each of its other buckets and balls. Buckets
that this leaves in more than one component are then searched across components, bucket by bucket: sketches (a byte of each minimum) sort
out pairs far below SIMILARITY, the others are verified on the spot, the likeliest first, and none is once its two sides are connected. So whatever shares a key is in one
component or has been compared, and only links leave a task.

Defined cases: as in simhash; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes
from corelens.operators.components import linked_components
from corelens.session import bounded_batches, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Equal bytes of two sketches below which a pair isn't verified; at 0.8 they are 128 of 160 on average, with a deviation of 5.
SKETCH_EQUAL = 104

_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: bytes | None) -> tuple[np.ndarray, bytes, int]:
    """Keys of the bands, the sketch and the SimHash fingerprint."""
    values = shingle_hashes(text, SHINGLE)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (_FACTORS[:, None] * values[None, at : at + 1024]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64)
    return keys.view(np.int64), (least >> np.uint64(16)).astype(np.uint8).tobytes(), fingerprint_of(values)


def similarity(a: bytes | None, b: bytes | None) -> float:
    x, y = (np.unique(shingle_hashes(t, SHINGLE)) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 1.0


def _signatures(docs: DataFrame) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [signature(t) for t in batch.column(1).to_pylist()]
            prints = np.array([fp for _, _, fp in all_], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.tolist() for k, _, _ in all_], pa.list_(pa.int64())), pa.array([s for _, s, _ in all_], pa.binary()), pa.array(prints)], names=["h", "keys", "sketch", "fp"])

    return docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(signed, "h long, keys array<long>, sketch binary, fp long")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of text hashes whose texts are similar enough."""
    pairs = written(pairs, "pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(members, "h", "left_semi").dropDuplicates(["h"])
    texts = written(texts, "texts")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [similarity(x, y) >= SIMILARITY for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    joined = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "near")


def _bucket_links(names: list[int], component: np.ndarray, sketch: np.ndarray, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Links that connect what is similar enough across the components of one bucket."""
    shingles: list[set | None] = [None] * len(names)

    def of(k: int) -> set:
        if shingles[k] is None:
            shingles[k] = set(shingle_hashes(texts[k], SHINGLE).tolist())
        return shingles[k]

    for i in range(len(names) - 1):
        other = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
        equal = (sketch[other] == sketch[i]).sum(axis=1)
        near = np.flatnonzero(equal >= SKETCH_EQUAL)
        for j in other[near[np.argsort(-equal[near], kind="stable")]].tolist():
            if component[j] != component[i]:
                x, y = of(i), of(j)
                common = len(x & y)
                union = len(x) + len(y) - common
                if not union or common >= SIMILARITY * union:
                    yield min(names[i], names[j]), max(names[i], names[j])
                    component[component == component[j]] = component[i]


def _across(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside one bucket and across components; rows: key, h, c (component), sketch, text."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None

        def ready() -> pa.RecordBatch:
            names, c, sketches, texts = ([r[k] for r in held] for k in range(4))
            sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(held), -1) if held else np.empty((0, 0), np.uint8)
            found = list(_bucket_links(names, np.array(c, np.int64), sketch, texts))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != bucket:
                    yield ready()
                    bucket = key
                held.append(tuple(row))
        yield ready()

    return rows.repartition("key").sortWithinPartitions("key", "h").select("key", "h", "c", "sketch", "text").mapInArrow(met, "a long, b long").distinct()


def _in_balls(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of text hashes by SimHash: texts of one fingerprint with its smallest, and fingerprints whose balls meet by their smallest texts."""
    distinct = written(signed.groupBy("fp").agg(F.min("h").alias("rep")), "distinct")
    same = signed.join(distinct, "fp").where("h <> rep").select(F.col("rep").alias("a"), F.col("h").alias("b"))
    return same.unionByName(fingerprint_links(distinct))


def _apart(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose components differ."""
    of = lambda side: names.select(F.col("vertex").alias(side), F.col("component").alias(f"of_{side}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """(vertex, component) of the hash of every text that has a near copy with a smaller one."""
    bounded_batches(docs.sparkSession)
    signed = written(_signatures(docs).dropDuplicates(["h"]), "signatures")
    rows = signed.select("h", F.explode("keys").alias("key"))
    centres = rows.groupBy("key").agg(F.min("h").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(rows.join(centres, "key"), "buckets")
    met = buckets.where("h <> centre").select(F.col("centre").alias("a"), F.col("h").alias("b")).unionByName(_in_balls(signed))
    offered = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "offered")
    first = offered.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    near = _verified(docs, first)
    others = _apart(offered.join(first, ["a", "b"], "left_anti"), written(linked_components(near), "names"))
    near = near.unionByName(_verified(docs, others))
    names = written(linked_components(near), "names")
    labelled = buckets.select("key", "h").join(names.select(F.col("vertex").alias("h"), "component"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("c"))
    split = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("key")
    apart = written(labelled.join(split, "key").join(signed.select("h", "sketch"), "h"), "apart")
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(apart.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    more = written(_across(apart.join(texts, "h")), "links")
    return linked_components(near.unionByName(more))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies, the one with the smallest doc_id (rows without an id come last); same columns."""
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    names = written(components(docs), "components").select(F.col("vertex").alias("_h"), "component")
    ids = keyed.select("_id", "_h").join(names, "_h", "left").select("_id", "_h", F.coalesce("component", "_h").alias("c"))
    first = ids.groupBy("c").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_h")).alias("m")).select(F.col("m._id").alias("_id1"), F.col("m._h").alias("_h"))
    kept = keyed.join(first.withColumnRenamed("_h", "_h1"), F.col("_h").eqNullSafe(F.col("_h1")) & F.col("_id").eqNullSafe(F.col("_id1")), "left_semi")
    return kept.dropDuplicates(["_id", "_h"]).select(*docs.columns)
