"""Block index of skyline points: sorted runs of points with their bounding boxes, in levels up to one root.

The tree that a search descends becomes a table: points are numbered in coordinate order, FANOUT consecutive numbers are a
block, FANOUT blocks are a block of the next level. A search takes enclosed blocks whole and tests single points only in blocks that it overlaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelens.functions import boxes
from corelens.functions.boxes import Box
from corelens.session import written

FANOUT = 64


def numbered(df: DataFrame, order: Sequence, name: str = "core_id") -> DataFrame:
    """df with consecutive numbers from 0 in the given order: range partitions are numbered inside, then shifted by the sizes before."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_k", F.row_number().over(inside) - 1).join(F.broadcast(shift), "_part").withColumn(name, F.col("_k") + F.col("_shift")).drop("_part", "_k", "_shift")


def core_points(skyline: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """(core_id, c0, ..., members): one row for each distinct coordinate, numbered in coordinate order."""
    points = skyline.groupBy(*coordinates).agg(F.count("*").alias("members"))
    return numbered(points, [F.col(c) for c in coordinates])


def blocks(points: DataFrame, coordinates: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """(level, block_id, parent, lo*, hi*, first_core, last_core, items) from the leaves (level 0) to one root."""
    dims = len(coordinates)
    edges = [*[F.col(c).alias(f"lo{i}") for i, c in enumerate(coordinates)], *[F.col(c).alias(f"hi{i}") for i, c in enumerate(coordinates)]]
    below = points.select(F.col("core_id").alias("block_id"), *edges, F.col("core_id").alias("first_core"), F.col("core_id").alias("last_core"))
    out, level, left = None, 0, points.count()
    while left:
        box = [*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(dims)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(dims)]]
        now = below.withColumn("block_id", F.expr(f"block_id div {fanout}")).groupBy("block_id").agg(*box, F.min("first_core").alias("first_core"), F.max("last_core").alias("last_core"), F.count("*").alias("items"))
        left = -(-left // fanout)
        row = now.select(F.lit(level).alias("level"), "block_id", (F.expr(f"block_id div {fanout}") if left > 1 else F.lit(None).cast("long")).alias("parent"), *[f"{e}{i}" for i in range(dims) for e in ("lo", "hi")], "first_core", "last_core", "items")
        out = row if out is None else out.unionByName(row)
        if left == 1:
            return out
        below, level = now.drop("items"), level + 1
    schema = ", ".join(["level int, block_id long, parent long", *(f"lo{i} int, hi{i} int" for i in range(dims)), "first_core long, last_core long, items long"])
    return points.sparkSession.createDataFrame([], schema)


def two_levels(tree: DataFrame) -> DataFrame:
    """The tree's leaves under a single root that holds them all, however many there are."""
    leaves = tree.where("level = 0")
    ends = [e.alias(e_name) for i in range(sum(c.startswith("lo") for c in tree.columns)) for e, e_name in ((F.min(f"lo{i}"), f"lo{i}"), (F.max(f"hi{i}"), f"hi{i}"))]
    root = leaves.agg(*ends, F.min("first_core").alias("first_core"), F.max("last_core").alias("last_core"), F.count("*").alias("items")).where("items > 1")
    root = root.withColumns({"level": F.lit(1), "block_id": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
    return leaves.withColumn("parent", F.when(F.col("parent").isNotNull(), F.lit(0).cast("long"))).unionByName(root)


def pruned(points: DataFrame, tree: DataFrame, query: Box, coordinates: Sequence[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(enclosed, rest): leaf blocks that lie in the query whole, and single points of the other blocks that lie in it."""
    dims = len(coordinates)
    leaves = tree.where("level = 0")
    b = boxes.box_of(dims)
    enclosed = leaves.where(boxes.encloses(query, b))
    partial = leaves.where(boxes.overlaps(query, b) & ~boxes.encloses(query, b)).select("block_id")
    inside = points.where(boxes.holds(query, [F.col(c) for c in coordinates])).withColumn("block_id", F.expr(f"core_id div {fanout}"))
    return enclosed, inside.join(partial, "block_id", "left_semi")


def accepted(points: DataFrame, query: Box | None, coordinates: Sequence[str], name: str = "enclosing") -> DataFrame:
    """Points that an acceptor takes; count() is the counting visit."""
    renamed = points.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(coordinates)})
    return renamed.where(boxes.acceptor(name, query, len(coordinates))[1])


def removed(points: DataFrame, coordinates: Sequence[str], query: Box | None = None, cores: DataFrame | None = None) -> DataFrame:
    """Points without those in a box and without those named by core_id; with neither, no point is left."""
    if query is None and cores is None:
        return points.limit(0)
    out = points if query is None else points.where(~boxes.holds(query, [F.col(c) for c in coordinates]))
    return out if cores is None else out.join(cores.select("core_id"), "core_id", "left_anti")


def index_bytes(tree: DataFrame, dims: int) -> DataFrame:
    """Bytes of a tree of these blocks: per node 8 for each dimension, 4 for each item and 9, and for leaves 4 for each item again."""
    size = F.lit(8 * dims + 9) + 4 * F.col("items") + F.when(F.col("level") == 0, 4 * F.col("items")).otherwise(0)
    return tree.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("level") + 1, F.lit(0)).cast("int").alias("height"), F.count("*").alias("nodes"))


def bitmap_sizes(skyline: DataFrame, points: DataFrame, coordinates: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Per leaf block, its distinct members: the bits of a membership bitmap."""
    ids = points.select(*coordinates, F.expr(f"core_id div {fanout}").alias("block_id"))
    return skyline.join(ids, list(coordinates)).groupBy("block_id").agg(F.countDistinct("v").alias("distinct_members"))
