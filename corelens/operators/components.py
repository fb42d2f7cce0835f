"""Connected components of an edge table, named by their smallest vertex.

Two engines give the same labels. `rounds` alternates the large-star and small-star steps as DataFrame joins: every
step keys a minimum per vertex, which Spark pre-aggregates, and joins it back, where adaptive execution splits a vertex
of very many edges. `one_task` runs union-find inside one task for graphs whose edge count is known to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.session import discard, written

#: Edges up to which one task labels a graph.
ONE_TASK_EDGES = 1_000_000


class DisjointSets:
    """Union-find whose root is always the smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        return True


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars that connect what a partition's edges connect; emptied whenever it has grown large, so memory is bounded."""
    sets = DisjointSets()

    def emptied() -> pd.DataFrame:
        pairs = [(x, sets.find(x)) for x in list(sets.parent)]
        sets.parent = {}
        out = pd.DataFrame([(low, x) for x, low in pairs if low != x], columns=["a", "b"], dtype="int64")
        return out

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > 500_000:
            yield emptied()
    yield emptied()


def _canonical(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.where("a <> b").select(low.alias("a"), high.alias("b"))


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a < b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
    lows = large.groupBy("b").agg(F.min("a").alias("m"))
    joined = large.join(lows, "b")
    small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
    return small.distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a < b) with the same components: each task's edges as stars."""
    return written(edges.mapInPandas(_forest, "a long, b long").distinct(), "cc")


def _rounds(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of contracted edges (a < b) that isn't its component's name."""
    now, state, most = edges, None, None
    while True:
        # A fixed point is a set of stars: then no vertex is both a centre and a leaf, and each leaf has one centre.
        # decimal sums cannot wrap
        summary = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(summary) == state:
            return now.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
        state, most = tuple(summary), 2 * summary[0]  # each edge gives two at most
        then = now
        now = written(_star_round(then), "cc", most)
        discard(then)


def _one_task(edges: DataFrame) -> DataFrame:
    return edges.coalesce(1).mapInPandas(_whole_forest, "a long, b long").select(F.col("b").alias("vertex"), F.col("a").alias("component"))


def _whole_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = DisjointSets()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            sets.union(a, b)
    yield pd.DataFrame([(low, x) for x in list(sets.parent) if (low := sets.find(x)) != x], columns=["a", "b"], dtype="int64")


def linked_components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(vertex, component) of every vertex that has a smaller one in its component.

    Edges are read once, contracted and counted; at most one_task_edges of them are labelled in one task, more in rounds.
    """
    contracted = _contracted(_canonical(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")))
    return _one_task(contracted) if contracted.count() <= one_task_edges else _rounds(contracted)


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, a: str = "a", b: str = "b", engine: str = "auto") -> DataFrame:
    """(vertex, component) for every vertex that an edge names or that `vertices` (its first column) lists.

    Self-loops count as isolated mentions; edges with a null end are dropped. engine: rounds, one_task, or auto, which
    contracts and counts the edges first.
    """
    if engine not in ("auto", "rounds", "one_task"):
        raise ValueError(f"unknown engine {engine!r}")
    narrow = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    pairs = _canonical(narrow)
    if engine == "auto":
        linked = linked_components(pairs)
    else:
        linked = _one_task(pairs) if engine == "one_task" else _rounds(_contracted(pairs))
    if vertices is None:
        vertices = narrow.select(F.explode(F.array("a", "b")).alias("vertex"))
    named = vertices.select(F.col(vertices.columns[0]).cast("long").alias("vertex")).where("vertex is not null").distinct()
    return named.join(linked, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
