"""The core index: skyline, row values, block tree and (optionally) spanning forests of a graph, and the searches on it.

Membership is dominance: the core of t is all vertices with a skyline point >= t. Connectivity inside the core comes from the
graph's links between members, or from a maximum spanning forest of the prefix: with the weight of a link the smaller last value of
its ends, the links of weight >= l connect just what the core of (prefix, l) connects, in at most n - 1 rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelens.functions import boxes
from corelens.operators import decompose
from corelens.operators.components import ONE_TASK_EDGES, DisjointSets, connected_components
from corelens.operators.graphs import Graph
from corelens.operators.peel import CompactArrays, flat, induced_links, merged, settled, thresholds
from corelens.plans import blocks as block_plans
from corelens.session import written

#: Thresholds up to which a list of queries is broadcast.
BROADCAST_QUERIES = 50_000


def forests(graph: Graph, prefixes: list[tuple[int, ...]]) -> DataFrame:
    """(c0, ..., a, b, w): a maximum spanning forest of every prefix; the graph must fit into arrays (see decompose)."""
    shared = decompose.shared_arrays(graph)
    if shared is None:
        raise ValueError("the graph is too large for forests; search on the graph's links instead")
    width, base = graph.dims - 1, graph.base

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        once = found.v < found.nbr
        a, b = found.v[once], found.nbr[once]
        for pdf in batches:
            for prefix in pdf.itertuples(index=False):
                last = found.last_values(tuple(prefix), base)
                w = np.minimum(last[a], last[b])
                order = np.flatnonzero(w >= base)
                order = order[np.argsort(-w[order], kind="stable")]
                sets = DisjointSets()
                kept = [k for k in order.tolist() if sets.union(int(a[k]), int(b[k]))]
                yield pd.DataFrame({**{f"c{k}": np.full(len(kept), p, "int32") for k, p in enumerate(prefix)}, "a": found.ids[a[kept]].astype("int64"), "b": found.ids[b[kept]].astype("int64"), "w": w[kept].astype("int32")})

    schema = ", ".join([*(f"c{k} int" for k in range(width)), "a long, b long, w int"])
    rows = decompose._prefix_rows(graph.edges.sparkSession, sorted(prefixes), width)
    return rows.mapInPandas(grown, schema)


@dataclass
class CoreIndex:
    graph: Graph
    rows: DataFrame
    skyline: DataFrame
    points: DataFrame
    tree: DataFrame
    forest: DataFrame | None = None
    fanout: int = field(default=block_plans.FANOUT)
    annotations: DataFrame | None = field(default=None, init=False, repr=False)

    # Building and storing

    @classmethod
    def build(cls, graph: Graph, forest: bool = False, fanout: int = block_plans.FANOUT) -> CoreIndex:
        graph = settled(graph)
        return cls.from_rows(graph, decompose.row_values(graph), forest, fanout)

    @classmethod
    def from_rows(cls, graph: Graph, rows: DataFrame, forest: bool = False, fanout: int = block_plans.FANOUT) -> CoreIndex:
        rows = written(rows, "rows")
        points_of = written(decompose.skyline(graph, rows), "skyline")
        points = written(block_plans.core_points(points_of, graph.coordinates), "points")
        tree = written(block_plans.blocks(points, graph.coordinates, fanout), "blocks")
        grown = None
        if forest and decompose.shared_arrays(graph) is not None:  # beyond that, searches run on the graph's links
            grown = written(forests(graph, [tuple(r) for r in rows.select(*graph.prefix_columns).distinct().collect()]), "forest")
        return cls(graph, rows, points_of, points, tree, grown, fanout)

    def save(self, path: str) -> None:
        """Tables in coordinate order, so that Parquet's statistics prune a search."""
        g = self.graph
        self.skyline.repartitionByRange(*g.coordinates).sortWithinPartitions(*g.coordinates).write.mode("overwrite").parquet(f"{path}/skyline")
        self.rows.repartitionByRange(*(g.prefix_columns or ["v"])).sortWithinPartitions(*g.prefix_columns, "last").write.mode("overwrite").parquet(f"{path}/rows")
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        self.tree.write.mode("overwrite").parquet(f"{path}/blocks")
        g.edges.write.mode("overwrite").parquet(f"{path}/edges")
        g.vertices().write.mode("overwrite").parquet(f"{path}/vertices")
        if self.forest is not None:
            self.forest.repartitionByRange(*g.prefix_columns, "w").sortWithinPartitions(*g.prefix_columns, "w").write.mode("overwrite").parquet(f"{path}/forest")
        spark = g.edges.sparkSession
        about = json.dumps({"kind": g.kind, "dims": g.dims, "layers": [str(x) for x in g.layers], "fanout": self.fanout, "forest": self.forest is not None})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CoreIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        extra = None if about["kind"] == "bipartite" else read("vertices").select("v")
        graph = Graph(about["kind"], read("edges"), extra, about["dims"], tuple(about["layers"]))
        return cls(graph, read("rows"), read("skyline"), read("points"), read("blocks"), read("forest") if about["forest"] else None, about["fanout"])

    # Searches

    def dominating(self, t: Sequence[int]) -> DataFrame:
        """core_id and coordinates of the points >= t."""
        t = thresholds(self.graph, t)
        return self.points.where(boxes.holds(boxes.dominance_box(t), [F.col(c) for c in self.graph.coordinates]))

    def on_row(self, t: Sequence[int]) -> DataFrame:
        """Points whose last coordinate is that of t and whose prefix is >= that of t."""
        t = thresholds(self.graph, t)
        return self.points.where(boxes.holds(boxes.row_box(t, len(t) - 1), [F.col(c) for c in self.graph.coordinates]))

    def members(self, t: Sequence[int]) -> DataFrame:
        t = thresholds(self.graph, t)
        return self.skyline.where(boxes.holds(boxes.dominance_box(t), [F.col(c) for c in self.graph.coordinates])).select("v").distinct()

    def components(self, t: Sequence[int], use_forest: bool = True, engine: str = "auto") -> DataFrame:
        """(v, component) of the core of t; component is the smallest vertex."""
        t = thresholds(self.graph, t)
        members = self.members(t)
        if use_forest and self.forest is not None:
            same = " and ".join([*(f"c{i} = {x}" for i, x in enumerate(t[:-1])), f"w >= {t[-1]}"])
            links = self.forest.where(same).select("a", "b")
        else:
            links = induced_links(self.graph, members)
        return connected_components(links, members, engine=engine).withColumnRenamed("vertex", "v")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, str]:
        """The queries with their coordinates as _c0, ..., and the condition under which a row of `rows` answers one: a row has a vertex once for each prefix."""
        g = self.graph
        q = queries.select("qid", *[F.greatest(F.col(c), F.lit(g.base)).alias(f"_{c}") for c in g.coordinates])
        side = F.broadcast(q) if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else q
        return side, " and ".join([*(f"{c} = _{c}" for c in g.prefix_columns), f"last >= _{g.coordinates[-1]}"])

    def batch_members(self, queries: DataFrame) -> DataFrame:
        """(qid, v) for all queries (qid, c0, ...) at once: a join on the prefix and a range of the last coordinate."""
        side, same = self._asked(queries)
        return self.rows.join(side, F.expr(same)).select("qid", "v")

    def batch_sizes(self, queries: DataFrame) -> DataFrame:
        """(qid, c0, ..., size) of every query, 0 where the core is empty: the join runs over counts by prefix and last value."""
        side, same = self._asked(queries)
        counts = self.rows.groupBy(*self.graph.prefix_columns, "last").agg(F.count("*").alias("n"))
        sizes = counts.join(side, F.expr(same)).groupBy("qid").agg(F.sum("n").alias("size"))
        return queries.join(sizes, "qid", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))

    def batch_components(self, queries: DataFrame) -> DataFrame:
        """(qid, v, component) for all queries at once. A query's answer is labelled in one task while the whole graph is small enough; a larger graph is swept prefix by prefix, and beyond TASK_EDGES query by query."""
        links = self.graph.links()
        if links.count() > ONE_TASK_EDGES:
            if self.graph.edges.count() <= decompose.TASK_EDGES:
                return _swept_components(self.graph, queries)
            out = None
            for r in queries.collect():
                one = self.components([r[c] for c in self.graph.coordinates]).select(F.lit(r["qid"]).cast("long").alias("qid"), "v", "component")
                out = one if out is None else out.unionByName(one)
            return out
        members = written(self.batch_members(queries), "members")
        pairs = members.join(links, F.col("v") == F.col("a")).select("qid", "a", "b").join(members.withColumnRenamed("v", "b"), ["qid", "b"], "left_semi")
        both = members.select("qid", F.col("v").alias("a"), F.col("v").alias("b")).unionByName(pairs.select("qid", "a", "b"))
        return both.groupBy("qid").applyInPandas(_labelled, "qid long, v long, component long")

    # What the index holds

    def vertex_cores(self) -> DataFrame:
        """(v, cores): the sorted core_ids of each vertex's skyline points."""
        g = self.graph
        return self.skyline.join(self.points.select("core_id", *g.coordinates), g.coordinates).groupBy("v").agg(F.sort_array(F.collect_list("core_id")).alias("cores"))

    def axis_maxima(self) -> DataFrame:
        """One row: the largest value of each coordinate."""
        return self.points.agg(*[F.max(c).alias(c) for c in self.graph.coordinates])

    def _annotations(self) -> DataFrame:
        """(prefix, w, kind, a, b) by one sweep a prefix down its forest: kind 0 is a link that a threshold leaves open, kind 2 a point's own vertex a in component b."""
        if self.forest is None:
            raise ValueError("built without forests")
        if self.annotations is None:
            g = self.graph
            rows = self.forest.select(*g.prefix_columns, "w", F.lit(0).alias("kind"), "a", "b")
            for c in g.prefix_columns:  # what the next prefix in each coordinate connects
                rows = rows.unionByName(self.forest.where(F.col(c) > g.base).withColumn(c, F.col(c) - 1).select(*g.prefix_columns, "w", F.lit(1).alias("kind"), "a", "b"))
            rows = rows.unionByName(self.skyline.select(*g.prefix_columns, F.col(g.coordinates[-1]).alias("w"), F.lit(2).alias("kind"), F.col("v").alias("a"), F.col("v").alias("b")))
            schema = ", ".join([*(f"{c} int" for c in g.prefix_columns), "w int, kind int, a long, b long"])
            self.annotations = written(rows.groupBy(*g.prefix_columns).applyInPandas(_swept, schema), "annotations")
        return self.annotations

    def subgraphs(self) -> DataFrame:
        """(core_id, component, v): each point's own vertices by component of its core."""
        g = self.graph
        if self.forest is not None:
            own = self._annotations().where("kind = 2").select(*g.prefix_columns, F.col("w").alias(g.coordinates[-1]), F.col("b").alias("component"), F.col("a").alias("v"))
            return own.join(self.points.select("core_id", *g.coordinates), g.coordinates).select("core_id", "component", "v")
        parts = self.batch_components(self.points.select(F.col("core_id").alias("qid"), *g.coordinates)).withColumnRenamed("qid", "core_id")
        own = self.skyline.join(self.points.select("core_id", *g.coordinates), g.coordinates).select("core_id", "v")
        return parts.join(own, ["core_id", "v"]).select("core_id", "component", "v")

    def block_tags(self) -> DataFrame:
        """(block_id, core_id, component, tag): per subgraph in a leaf block, the component of the core of the block's lower corner that it falls in."""
        g = self.graph
        leaves = self.tree.where("level = 0")
        corner = self.batch_components(leaves.select(F.col("block_id").alias("qid"), *[F.col(f"lo{i}").alias(c) for i, c in enumerate(g.coordinates)])).select(F.col("qid").alias("block_id"), "v", F.col("component").alias("tag"))
        subs = self.subgraphs().withColumn("block_id", F.expr(f"core_id div {self.fanout}"))
        return subs.join(corner, ["block_id", "v"]).select("block_id", "core_id", "component", "tag").distinct()

    def open_links(self) -> DataFrame:
        """(c0, ..., a, b): for every threshold the fewest links that connect its core, given what the next higher thresholds connect and the subgraphs of its own point."""
        g = self.graph
        return self._annotations().where("kind = 0").select(*g.prefix_columns, F.col("w").alias(g.coordinates[-1]), "a", "b")

    def connect_edges(self) -> DataFrame:
        """(core_id, a, b): open links, each at a point of one of its ends that dominates the threshold. With the subgraphs they connect any core: see annotated_components."""
        g = self.graph
        own = self.skyline.join(self.points.select("core_id", *g.coordinates), g.coordinates).select("core_id", "v", *[F.col(c).alias(f"_{c}") for c in g.coordinates])
        ends = self.open_links().withColumn("v", F.explode(F.array("a", "b")))
        # The end that is new at the threshold has a point with just its last coordinate.
        above = F.expr(" and ".join([*(f"_{c} >= {c}" for c in g.prefix_columns), f"_{g.coordinates[-1]} = {g.coordinates[-1]}"]))
        return ends.join(own, "v").where(above).groupBy(*g.coordinates, "a", "b").agg(F.min("core_id").alias("core_id")).select("core_id", "a", "b").distinct()

    def annotated_components(self, t: Sequence[int]) -> DataFrame:
        """(v, component) of the core of t from subgraphs and connect edges of the points that dominate t, without the graph."""
        cores = self.dominating(t).select("core_id")
        pieces = self.subgraphs().join(cores, "core_id", "left_semi").select(F.struct("core_id", "component").alias("piece"), "v")
        return merge_pieces(pieces, self.connect_edges().join(cores, "core_id", "left_semi"))

    def out_edges(self) -> DataFrame:
        """(block_id, a, b): connect edges of a leaf block's points with an end outside the block's members."""
        g = self.graph
        inside = self.skyline.join(self.points.select("core_id", *g.coordinates), g.coordinates).select(F.expr(f"core_id div {self.fanout}").alias("block_id"), "v").distinct()
        edges = self.connect_edges().select(F.expr(f"core_id div {self.fanout}").alias("block_id"), "a", "b").distinct()
        both = edges.join(inside.withColumnRenamed("v", "a"), ["block_id", "a"], "left_semi").join(inside.withColumnRenamed("v", "b"), ["block_id", "b"], "left_semi")
        return edges.join(both.select("block_id", "a", "b"), ["block_id", "a", "b"], "left_anti")

    def stats(self) -> DataFrame:
        """One row: points, memberships, subgraphs, and the height and bytes of points and tree."""
        own = self.points.agg(F.count("*").alias("cores"), F.sum("members").alias("memberships"), F.sum(8 + 4 * F.col("members")).cast("long").alias("core_bytes"))
        subs = self.subgraphs().select("core_id", "component").distinct().agg(F.count("*").alias("subgraphs"))
        size = block_plans.index_bytes(self.tree, self.graph.dims).withColumnRenamed("bytes", "tree_bytes")
        out = own.crossJoin(subs).crossJoin(size)  # single rows
        if self.forest is None:
            return out
        links = self.connect_edges().agg(F.count("*").alias("connect_edges")).crossJoin(self.out_edges().agg(F.count("*").alias("out_edges")))
        return out.crossJoin(links).withColumn("annotation_bytes", F.col("height") * F.col("subgraphs") * 4 + (F.col("out_edges") + F.col("connect_edges")) * 8)

    def explain(self, t: Sequence[int]) -> str:
        """The physical plan of a membership search."""
        return self.members(t)._jdf.queryExecution().explainString(self.graph.edges.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _swept_components(graph: Graph, queries: DataFrame) -> DataFrame:
    """(qid, v, component): a task reads the graph and sweeps some prefixes, each from its highest threshold down, so that links are joined once a prefix."""
    graph = settled(graph)
    kind, dims, base = graph.kind, graph.dims, graph.base
    by: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for r in queries.collect():
        t = thresholds(graph, [r[c] for c in graph.coordinates])
        by.setdefault(t[:-1], []).append((t[-1], r["qid"]))

    def task(run: list[tuple[int, ...]]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = CompactArrays(kind, dims, batches, links=True)
            a, b = found.links
            for prefix in run:
                state = found.start()
                found.peel(state, [*prefix, base])
                last = found.last_values(state, prefix, base)
                w = np.minimum(last[a], last[b])
                label, above = np.arange(found.n), np.iinfo(np.int32).max
                for level, qid in sorted(by[prefix], reverse=True):
                    fresh = (w >= level) & (w < above)
                    label, above = merged(label, a[fresh], b[fresh]), min(above, level)
                    here = np.flatnonzero(last >= level)
                    for at in range(0, len(here), decompose.ROWS_AT_ONCE):
                        some = here[at : at + decompose.ROWS_AT_ONCE]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), qid, np.int64)), pa.array(found.ids[some], pa.int64()), pa.array(found.ids[label[some]], pa.int64())], names=["qid", "v", "component"])

        return work

    spark, schema = graph.edges.sparkSession, "qid long, v long, component long"
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # as in decompose
    tasks, prefixes = spark.sparkContext.defaultParallelism, sorted(by)
    out = None
    for run in [prefixes[i::tasks] for i in range(min(tasks, len(prefixes)))]:
        part = flat(graph).coalesce(1).mapInArrow(task(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = DisjointSets()
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        sets.union(a, b)
        sets.find(a)
    v = sorted(sets.parent)
    return pd.DataFrame({"qid": np.full(len(v), pdf["qid"].iloc[0], "int64"), "v": np.array(v, "int64"), "component": np.array([sets.find(x) for x in v], "int64")})


def _swept(pdf: pd.DataFrame) -> pd.DataFrame:
    """One prefix, from its highest last value down: real has the components of its cores, known what is connected without open links."""
    pdf = pdf.sort_values(["w", "kind", "a", "b"], ascending=[False, True, True, True], kind="stable")
    w, kind, a, b = (pdf[c].tolist() for c in ("w", "kind", "a", "b"))
    real, known = DisjointSets(), DisjointSets()
    out: list[tuple[int, int, int, int]] = []
    at = 0
    while at < len(w):
        end, level, first = at, w[at], {}
        while end < len(w) and w[end] == level:
            if kind[end] == 0:
                real.union(a[end], b[end])
            elif kind[end] == 1:
                known.union(a[end], b[end])
            else:
                component = real.find(a[end])
                known.union(first.setdefault(component, a[end]), a[end])
                out.append((level, 2, a[end], component))
            end += 1
        out += [(level, 0, a[k], b[k]) for k in range(at, end) if kind[k] == 0 and known.union(a[k], b[k])]
        at = end
    found = pd.DataFrame(out, columns=["w", "kind", "a", "b"])
    for k, c in enumerate(pdf.columns[:-4]):
        found.insert(k, c, pdf[c].iloc[0])
    return found


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def component_members(components: DataFrame) -> DataFrame:
    """(component, members): sorted vertex arrays."""
    return components.groupBy("component").agg(F.sort_array(F.collect_set("v")).alias("members"))


def largest_components(components: DataFrame, k: int) -> DataFrame:
    """The k largest components, ties by the smaller name."""
    return component_sizes(components).orderBy(F.desc("size"), "component").limit(k)


def merge_pieces(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(v, component): one answer from pieces (piece, v) that are connected in themselves, and links between members."""
    members = pieces.select("v").distinct()
    first = pieces.groupBy("piece").agg(F.min("v").alias("a"))
    inside = pieces.join(first, "piece").select("a", F.col("v").alias("b"))
    between = links.join(members.withColumnRenamed("v", "a"), "a", "left_semi").join(members.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
    return connected_components(inside.unionByName(between), members).withColumnRenamed("vertex", "v")
