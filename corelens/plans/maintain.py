"""Index maintenance under batches of inserted and deleted edges.

apply_updates(index, adds, deletes) equals building on (edges + adds) - deletes, and recomputes only prefixes whose rows can have
changed. An inserted edge can matter for a prefix only if both ends have the degrees that the prefix asks for in the new
graph; a deleted edge only if both ends were in the prefix's largest core. Connectivity needs no upkeep of its own: it is
derived from the new links (or the forests of the recomputed prefixes).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.operators import decompose
from corelens.operators.graphs import Graph
from corelens.plans.index import CoreIndex, forests
from corelens.session import written

#: Affected prefixes beyond which a rebuild is cheaper than listing them.
MOST_PREFIXES = 20_000


def updated_graph(graph: Graph, adds: DataFrame | None, deletes: DataFrame | None) -> Graph:
    if adds is not None:
        graph = graph.with_edges(adds)
    return graph.without_edges(deletes) if deletes is not None else graph


def _ends(graph: Graph, edges: DataFrame) -> DataFrame:
    """(a, b) in engine numbers of edges in the model's columns."""
    return Graph(graph.kind, edges.select(*graph.edges.columns), None, graph.dims).links()


def _insert_caps(after: Graph, added: DataFrame) -> set[tuple[int, ...]]:
    """For each inserted edge the largest prefix that both ends' degrees allow; dominated ones left out."""
    ends = _ends(after, added)
    touched = ends.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    width = after.dims - 1
    degree = after.degrees().join(touched, "v", "left_semi").groupBy("v").agg(F.first("v").alias("_"), *[F.coalesce(F.max(F.when(F.col("dim") == i, F.col("degree"))), F.lit(0)).alias(f"c{i}") for i in range(width)])
    # An end that a coordinate doesn't bind allows any value of it.
    bound = after.vertices().join(degree, "v").select("v", *[F.when(F.col("dims").bitwiseAND(F.lit(1 << i)) == 0, F.lit((1 << 31) - 1)).otherwise(F.col(f"c{i}")).alias(f"c{i}") for i in range(width)])
    one, two = bound.withColumnsRenamed({f"c{i}": f"x{i}" for i in range(width)}).withColumnRenamed("v", "a"), bound.withColumnsRenamed({f"c{i}": f"y{i}" for i in range(width)}).withColumnRenamed("v", "b")
    caps = ends.join(one, "a").join(two, "b").select(*[F.least(f"x{i}", f"y{i}").alias(f"c{i}") for i in range(width)]).distinct()
    found = {tuple(r) for r in caps.collect()}
    return {p for p in found if not any(q != p and all(x >= y for x, y in zip(q, p, strict=True)) for q in found)}


def affected_prefixes(index: CoreIndex, after: Graph, adds: DataFrame | None, deletes: DataFrame | None) -> set[tuple[int, ...]] | None:
    """Prefixes to recompute; None if there are too many to list."""
    graph, out = index.graph, set()
    if adds is not None:
        fresh = adds.select(*graph.edges.columns).join(graph.edges, graph.edges.columns, "left_anti").distinct()
        caps = _insert_caps(after, fresh)
        total = 0
        for cap in caps:
            size = 1
            for x in cap:
                size *= max(0, x - graph.base + 1)
            total += size
        if total > MOST_PREFIXES:
            return None
        for cap in caps:
            out |= set(itertools.product(*(range(graph.base, x + 1) for x in cap)))
    if deletes is not None:
        ends = _ends(graph, deletes)
        prefix = graph.prefix_columns
        rows = index.rows.select(*prefix, "v")
        both = ends.join(rows.withColumnRenamed("v", "a"), "a").join(rows.withColumnRenamed("v", "b"), ["b", *prefix]).select(*prefix).distinct()
        out |= {tuple(r) for r in both.collect()}
    return out


def apply_updates(index: CoreIndex, adds: DataFrame | None = None, deletes: DataFrame | None = None) -> CoreIndex:
    """The index of (edges + adds) - deletes; both in the model's edge columns (layers as coordinate numbers `dim`, ends a < b)."""
    graph = index.graph
    after = updated_graph(graph, adds, deletes)
    after = Graph(after.kind, written(after.edges, "edges"), None if after.extra is None else written(after.extra, "vertices"), after.dims, after.layers)
    prefixes = affected_prefixes(index, after, adds, deletes)
    if prefixes is None or not graph.prefix_columns:
        return CoreIndex.build(after, index.forest is not None, index.fanout)
    if not prefixes:
        return CoreIndex.from_rows(after, index.rows, index.forest is not None, index.fanout)
    spark = graph.edges.sparkSession
    touched = F.broadcast(spark.createDataFrame(sorted(prefixes), ", ".join(f"{c} int" for c in graph.prefix_columns)))  # MOST_PREFIXES or the old prefixes at most
    kept = index.rows.join(touched, graph.prefix_columns, "left_anti")
    rows = kept.unionByName(decompose.row_values(after, sorted(prefixes)).select(*index.rows.columns))
    out = CoreIndex.from_rows(after, rows, False, index.fanout)
    if index.forest is not None:
        grown = forests(after, sorted(prefixes))
        out.forest = written(index.forest.join(touched, graph.prefix_columns, "left_anti").unionByName(grown), "forest")
    return out


def skyline_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Skyline rows with state `new` (only after) or `old` (only before)."""
    names = before.columns
    added = after.select(*names).exceptAll(before).withColumn("state", F.lit("new"))
    return added.unionByName(before.exceptAll(after.select(*names)).withColumn("state", F.lit("old")))


def apply_skyline_delta(skyline: DataFrame, delta: DataFrame) -> DataFrame:
    """A skyline with the `old` rows of a given delta replaced by its `new` ones."""
    names = skyline.columns
    kept = skyline.join(delta.where("state = 'old'").select(*names), names, "left_anti")
    return kept.unionByName(delta.where("state = 'new'").select(*names)).distinct()


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(v, change) between two answers: `enter` or `leave`."""
    entered = after.select("v").subtract(before.select("v")).withColumn("change", F.lit("enter"))
    return entered.unionByName(before.select("v").subtract(after.select("v")).withColumn("change", F.lit("leave")))


def what_if(index: CoreIndex, batches: Iterable[tuple[DataFrame | None, DataFrame | None]]) -> list[CoreIndex]:
    """Each batch (adds, deletes) applied to the same index, independent of the others."""
    return [apply_updates(index, adds, deletes) for adds, deletes in batches]
