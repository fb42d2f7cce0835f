"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most RADIUS = 3 bits if and only if some value lies within 1 bit of one and 2 bits of the other.
So every distinct fingerprint emits its variants within half the radius (1 bit, and 2 bits for the larger half), variants
meet by value, and what meets is verified.

A fingerprint has 1 + 64 + 2016 variants. They aren't shuffled one by one: the shuffle key is a prefix of the variant, so
a fingerprint travels once for every prefix that its variants have (37 times for 8 bits), and a task spells out the remaining bits
of one prefix at a time. The prefix is so long that a prefix has about GROUP rows; a prefix with more than GROUP_LIMIT rows is refined by
further bits, again and again, so a crowd of similar fingerprints spreads over many groups and none is dropped.

Where variants meet, all who are within 1 bit are within 2 of each other, and all who are within 2 bits are within 3 of them, so
links to the smallest of the former keep every connection without emitting all pairs. Copies of a text share a
fingerprint and enter once.

Defined cases: a null or empty text, or one of white space only, has no words and fingerprint zero, and is linked like any
other; fewer words than a shingle make one shingle of all; repeated rows give repeated, equal rows; a null doc_id
never names a component (null if its whole component has no id); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.operators.components import linked_components
from corelens.session import bounded_batches, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Rows of a prefix that the first split aims at, rows beyond which a prefix is split again, and by how many bits.
GROUP, GROUP_LIMIT, MORE_BITS = 20_000, 60_000, 6

#: Links, counted after contraction, up to which one task labels the components; more are labelled in rounds of joins.
ONE_TASK_LINKS = 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONE = np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of so many words of a UTF-8 text, of all its words if they are fewer; none without words."""
    words = (text or b"").translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, "<u8")


def fingerprint_of(values: np.ndarray) -> int:
    """Bit b is set if more than half of the values have it set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(values))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text from the XXH64 values of its shingles."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp) of every row; h is a hash of the text as it is, fp the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "doc_id long, h long, fp long")


def _masks(bits: int) -> list[int]:
    return [0, *(1 << i for i in range(bits)), *(1 << i | 1 << j for i in range(bits) for j in range(i))]


def _longer(rows: DataFrame, depth: int, bits: int) -> DataFrame:
    """Rows (prefix, used, fp, rep) of `depth` bits, dealt to every prefix of `bits` more bits that at most 2 flips in all reach."""
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("flips")) for m in _masks(bits)])
    next_bits = F.shiftrightunsigned(F.col("fp"), 64 - depth - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    reach = F.filter(masks, lambda m: m["flips"] + F.col("used") <= 2)
    dealt = rows.select("prefix", "used", "fp", "rep", F.explode(reach).alias("m"))
    return dealt.select(F.shiftleft("prefix", bits).bitwiseOR(next_bits.bitwiseXOR(F.col("m.mask"))).alias("prefix"), (F.col("used") + F.col("m.flips")).alias("used"), "fp", "rep")


def _links_of(fp: np.ndarray, used: np.ndarray, rep: np.ndarray, free: int) -> np.ndarray:
    """Links (rep, rep) among the rows of one prefix with `free` further bits."""
    low = fp & np.uint64((1 << free) - 1)
    flips = np.array([0, *(1 << i for i in range(free))], np.uint64)
    pairs = np.array([1 << i | 1 << j for i in range(free) for j in range(i)], np.uint64)
    zero, one, two = (np.flatnonzero(used == k) for k in (0, 1, 2))
    near = np.concatenate([(low[zero][:, None] ^ flips[None, :]).ravel(), low[one]])  # variants within 1 bit
    if not len(near):
        return np.empty((0, 2), np.int64)
    who = np.concatenate([np.repeat(zero, len(flips)), one])
    order = np.lexsort((rep[who], near))
    near, who = near[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
    values, centre = near[first], who[first]
    found = [np.stack([who, np.repeat(centre, np.diff(np.append(first, len(near))))], axis=1)]
    found[0] = found[0][found[0][:, 0] != found[0][:, 1]]

    def meet(variants: np.ndarray, members: np.ndarray) -> None:
        at = np.searchsorted(values, variants)
        at[at == len(values)] = 0
        hit = values[at] == variants
        both = np.stack([members[hit], centre[at[hit]]], axis=1)
        found.append(np.unique(both[both[:, 0] != both[:, 1]], axis=0))

    block = max(1, 400_000 // max(1, len(pairs)))
    for at in range(0, len(zero) if len(pairs) else 0, block):
        some = zero[at : at + block]
        meet((low[some][:, None] ^ pairs[None, :]).ravel(), np.repeat(some, len(pairs)))
    if free:
        block = max(1, 400_000 // free)
        for at in range(0, len(one), block):
            some = one[at : at + block]
            meet((low[some][:, None] ^ flips[None, 1:]).ravel(), np.repeat(some, free))
    meet(low[two], two)
    both = np.unique(np.concatenate(found), axis=0)
    close = np.bitwise_count(fp[both[:, 0]] ^ fp[both[:, 1]]) <= RADIUS
    out = np.sort(rep[both[close]], axis=1)
    return np.unique(out[out[:, 0] != out[:, 1]], axis=0)


def _met(rows: DataFrame, depth: int) -> DataFrame:
    """Links of all prefixes of `depth` bits; a task reads one prefix at a time."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        prefix = None

        def ready() -> Iterator[pa.RecordBatch]:
            if held:
                fp, used, rep = (np.concatenate(x) for x in zip(*held, strict=True))
                if len(fp) > 1 and len(both := _links_of(fp.view(np.uint64), used, rep, 64 - depth)):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
                held.clear()

        for batch in batches:
            if not len(batch):
                continue
            key, used, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if key[a] != prefix:
                    yield from ready()
                    prefix = key[a]
                held.append((fp[a:b], used[a:b], rep[a:b]))
        yield from ready()

    groups = rows.repartition("prefix").sortWithinPartitions("prefix")
    return groups.select("prefix", "used", "fp", "rep").mapInArrow(linked, "a long, b long")


def fingerprint_links(prints: DataFrame, group: int = GROUP, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (columns fp, rep) that connect all at RADIUS bits or fewer."""
    n = prints.count()
    depth = 0
    while depth < 40 and n * len(_masks(depth)) / 2**depth > group:
        depth += 1
    rows = prints.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used"), "fp", "rep")
    links = None
    rows = _longer(rows, 0, depth) if depth else rows
    while True:
        sizes = rows.groupBy("prefix").count()
        if depth == 64 or (sizes.agg(F.max("count")).first()[0] or 0) <= limit:
            here, rest = rows, None
        else:
            crowded = written(sizes.where(F.col("count") > limit).select("prefix"), "crowded")
            here, rest = rows.join(crowded, "prefix", "left_anti"), rows.join(crowded, "prefix", "left_semi")
        met = _met(here, depth) if depth < 64 else _exact(here)
        links = met if links is None else links.unionByName(met)
        if rest is None:
            return links.distinct()
        bits = min(MORE_BITS, 64 - depth)
        rows, depth = _longer(rest, depth, bits), depth + bits


def _exact(rows: DataFrame) -> DataFrame:
    """Rows whose prefix is the whole variant: each who reached it links to the smallest within 1 bit."""
    centre = rows.where("used <= 1").groupBy("prefix").agg(F.min("rep").alias("a"))
    return rows.join(centre, "prefix").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).where("a <> b")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp and component_id of every row."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct", prints.count())
    linked = linked_components(fingerprint_links(distinct.select("fp", F.col("fp").alias("rep"))), one_task_edges=ONE_TASK_LINKS)
    rooted = distinct.join(linked.select(F.col("vertex").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    names = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(names, "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable over links) of every row."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
