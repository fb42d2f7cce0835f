"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A document's size is its number of words. Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; targets share
out the words of all documents by weight, stop at MOST_REPEATS times a source's own words, and what lies above is shared again.

The mix has as many slots as blocks make up all words. Slot n has the golden-ratio point frac(n * phi), which the cumulative target shares map to
a source; the schedule alone decides how many slots a source gets and where they stand. A source's documents stand
in hashed order as one stream, repeated up to MOST_REPEATS times and cut into blocks; the r-th slot of a source
takes its r-th block. Points of low discrepancy leave each source within a few blocks of its target.

A block has ceil(words / SLOTS) words, MOST_BLOCK at most: so small a part of all words that a few of them don't show, while the schedule
and the pieces that documents are cut into stay small. The mix is read by slots: `slots` names where each copy of a document begins.

Ranks and stream positions are running counts over a source, which may hold a third of all rows. They come in two levels,
sums of chunks and counts inside a chunk, with about as many chunks as rows in a chunk, so no task sorts a whole source.

Defined cases: a null text has size 0, as has one of white space, and takes nothing; with no words at all, all targets are
0; equal rows are separate documents; a null doc_id is kept; an empty table gives an empty table; further columns are ignored. Sources are
names of collections: their sums, targets and arcs are a row for each on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelens.session import written

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
SLOTS, MOST_BLOCK = 1 << 20, 1 << 18
#: 2**32 over the golden ratio, made odd; the points are exact in 64-bit integers.
GOLDEN, SPAN = 2_654_435_769, 1 << 32
CELLS = 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> list[float]:
    """Target of each source, in the order of sizes."""
    own = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    while True:
        free = [k for k, x in enumerate(out) if x is None]
        rest = sum(sizes) - sum(x for x in out if x is not None)
        total = sum(own[k] for k in free)
        over = [k for k in free if rest * own[k] / total > repeats * sizes[k]]
        if not over:
            return [x if x is not None else rest * own[k] / total for k, x in enumerate(out)]
        for k in over:
            out[k] = float(repeats * sizes[k])


def block_words(total: int) -> int:
    """Words of a block when all documents have `total`."""
    return min(MOST_BLOCK, max(1, -(-total // SLOTS)))


def _chunks(n: int) -> int:
    return max(1, math.isqrt(n))


def _positions(sized: DataFrame, n: int) -> DataFrame:
    """Adds `start`, the words before a document in its source's stream."""
    dealt = sized.withColumn("chunk", F.pmod(F.col("h"), F.lit(_chunks(n))))
    before = Window.partitionBy("ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("ix", "chunk").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy("ix", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["ix", "chunk"]).withColumn("start", F.col("offset") + F.col("inside")).drop("offset", "inside", "chunk")


def schedule(spark, wanted: list[float], block: int) -> DataFrame:
    """(slot, ix, rank): which source each slot takes, and how many slots that source had before. wanted: words of each source."""
    total = sum(wanted)
    n = -(-int(round(total)) // block)
    edges, at = [0], 0.0
    for x in wanted:
        at += x
        edges.append(min(SPAN, round(SPAN * at / total)) if total else 0)
    if total:
        edges[-1] = SPAN
    step = SPAN // CELLS
    arcs = [(cell, ix, lo, hi) for ix, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo for cell in range(lo // step, (hi - 1) // step + 1)]
    arcs_df = spark.createDataFrame(arcs, "cell long, ix int, lo long, hi long")
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 31)) * F.lit(GOLDEN).cast("long") % SPAN).alias("p")).withColumn("cell", F.expr(f"p div {step}"))
    # arcs: at most a row for each cell and one for each source
    size = max(1, math.isqrt(n))
    mapped = points.join(F.broadcast(arcs_df), "cell").where("p >= lo and p < hi").select("slot", "ix", F.expr(f"slot div {size}").alias("chunk"))
    counts = mapped.groupBy("ix", "chunk").count()
    before = Window.partitionBy("ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("ix", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("ix", "chunk").orderBy("slot")
    return mapped.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["ix", "chunk"]).select("slot", "ix", (F.col("offset") + F.col("k")).alias("rank"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int | None = None) -> DataFrame:
    """doc_id, source, h (hash of the row's text), size, source_size, target, taken, first_slot and copies of every row.

    copies: (slot, words) of each time that the mix takes words of the document, in the order of the mix; first_slot: the first of their slots.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in sums], weights) if sums else []
    named = spark.createDataFrame([(r["source"], k, r["words"], t) for k, (r, t) in enumerate(zip(sums, wanted, strict=True))], "name string, ix int, source_size long, target double")
    placed = _positions(sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name"))).drop("name"), sum(r["n"] for r in sums))
    block = block or block_words(sum(r["words"] for r in sums))
    slots = schedule(spark, wanted, block)
    # The pieces of a document: for each time its stream comes round, its words in each block.
    rounds = F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda e: F.struct(e.alias("e"), (F.col("start") + e * F.col("source_size")).alias("a"), (F.col("start") + e * F.col("source_size") + F.col("size")).alias("b")))
    cut = F.flatten(
        F.transform(
            F.filter(rounds, lambda x: x["b"] > x["a"]),
            lambda x: F.transform(
                F.sequence(F.floor(x["a"] / block), F.floor((x["b"] - 1) / block)),
                lambda r: F.struct(r.cast("long").alias("rank"), x["e"].alias("e"), (F.least(x["b"], (r + 1) * block) - F.greatest(x["a"], r * block)).cast("long").alias("words")),
            ),
        )
    )
    nothing = F.array(F.struct((-1 - F.pmod(F.col("h"), F.lit(1 << 40))).cast("long").alias("rank"), F.lit(-1).alias("e"), F.lit(0).cast("long").alias("words")))  # each document has a row at least; no slot has this rank
    pieces = placed.select("doc_id", "source", "h", "ix", "size", "source_size", "target", "start", F.explode(F.concat(nothing, cut)).alias("p")).select("*", "p.rank", "p.e", "p.words").drop("p")
    joined = pieces.join(slots, ["ix", "rank"], "left")
    taken = F.when(F.col("slot").isNotNull(), F.struct("e", "slot", "words"))
    # Documents without words may share all of these columns: `rows` counts them, and each gets its row back.
    summed = joined.groupBy("ix", "start", "doc_id", "source", "h", "size", "source_size", "target").agg(F.collect_list(taken).alias("parts"), F.sum(F.when(F.col("e") < 0, 1).otherwise(0)).alias("rows"))

    def copy(e: Column) -> Column:
        own = F.filter("parts", lambda p: p["e"] == e)
        return F.struct(F.array_min(F.transform(own, lambda p: p["slot"])).alias("slot"), F.aggregate(own, F.lit(0).cast("long"), lambda x, p: x + p["words"]).alias("words"))

    copies = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), copy), lambda c: c["words"] > 0))
    each = summed.withColumn("copies", copies).withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    total = F.aggregate("copies", F.lit(0).cast("long"), lambda x, c: x + c["words"])
    return each.select("doc_id", "source", "h", "size", "source_size", "target", total.alias("taken"), F.element_at("copies.slot", F.when(F.size("copies") > 0, 1)).alias("first_slot"), "copies")


def mix_documents(docs: DataFrame, ordered: bool = True) -> DataFrame:
    """The mix itself: each document as often as it was taken, and a copy that was taken in part cut to its first words; same columns.

    ordered: rows stand in the order of the schedule's slots, partition by partition; without, their order is left open and a shuffle saved.
    """
    per = mixed(docs).where("taken > 0").select("doc_id", "source", "h", "size", F.explode("copies").alias("c")).select("doc_id", "source", "h", "size", "c.slot", "c.words")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_source": F.col("source").cast("string"), "_h": F.xxhash64("doc_id", "text")}).dropDuplicates(["_id", "_source", "_h"])
    per = per.toDF("_pid", "_psource", "_ph", "_size", "_slot", "_words")
    out = keyed.join(per, F.expr("_h = _ph and _id <=> _pid and _source <=> _psource"))
    head = F.array_join(F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+"), F.lit(1), F.col("_words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("_words") < F.col("_size"), head).otherwise(F.col("text")))
    if ordered:
        out = out.repartitionByRange("_slot", "_h").sortWithinPartitions("_slot", "_h")
    return out.select(*docs.columns)
