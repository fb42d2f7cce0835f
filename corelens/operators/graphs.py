"""Graphs as DataFrames: directed, bipartite and multilayer graphs in one normal form.

All three models are a set of degree bounds. `arcs(dim, v, nbr)` says that nbr counts towards vertex v in coordinate dim, and
`vertices(v, dims)` has a bit for every coordinate that binds v:

* directed: coordinate 0 counts in-neighbours and 1 out-neighbours; both bind every vertex;
* bipartite: coordinate 0 binds left vertices and 1 right vertices;
* multilayer: coordinate i counts neighbours in layer i; all bind every vertex.

Self-loops (but for bipartite graphs, where sides differ) and duplicate edges are dropped. Null ends raise ValueError
where they are looked for (`validate`), and are left out of the arcs in any case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Right vertices of a bipartite graph are numbered from here inside the engine, so left ones come first. |id| must stay below half of it.
RIGHT = 1 << 61


@dataclass
class Graph:
    """kind, edges in the model's own columns, vertices beyond those on edges, and the number of coordinates."""

    kind: str
    edges: DataFrame
    extra: DataFrame | None
    dims: int
    layers: tuple = ()

    @property
    def base(self) -> int:
        """The smallest threshold that has a meaning: a bipartite vertex without edges is in no core."""
        return 1 if self.kind == "bipartite" else 0

    @property
    def prefix_columns(self) -> list[str]:
        return [f"c{i}" for i in range(self.dims - 1)]

    @property
    def coordinates(self) -> list[str]:
        return [f"c{i}" for i in range(self.dims)]

    def arcs(self) -> DataFrame:
        if self.kind == "directed":
            pair = F.array(F.struct(F.lit(0).alias("dim"), F.col("dst").alias("v"), F.col("src").alias("nbr")), F.struct(F.lit(1).alias("dim"), F.col("src").alias("v"), F.col("dst").alias("nbr")))
        elif self.kind == "bipartite":
            right = F.col("v") + F.lit(RIGHT)
            pair = F.array(F.struct(F.lit(0).alias("dim"), F.col("u").alias("v"), right.alias("nbr")), F.struct(F.lit(1).alias("dim"), right.alias("v"), F.col("u").alias("nbr")))
        else:
            pair = F.array(F.struct(F.col("dim"), F.col("a").alias("v"), F.col("b").alias("nbr")), F.struct(F.col("dim"), F.col("b").alias("v"), F.col("a").alias("nbr")))
        return self.edges.select(F.explode(pair).alias("x")).select("x.*")

    def links(self) -> DataFrame:
        """Undirected, layer-free edges (a, b) for connectivity."""
        if self.kind == "directed":
            ends = (F.col("src"), F.col("dst"))
        elif self.kind == "bipartite":
            ends = (F.col("u"), F.col("v") + F.lit(RIGHT))
        else:
            ends = (F.col("a"), F.col("b"))
        return self.edges.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()

    def vertices(self) -> DataFrame:
        """(v, dims): every vertex and the coordinates that bind it, as bits."""
        if self.kind == "bipartite":
            left = self.edges.select(F.col("u").alias("v"), F.lit(1).alias("dims"))
            return left.unionByName(self.edges.select((F.col("v") + F.lit(RIGHT)).alias("v"), F.lit(2).alias("dims"))).distinct()
        ends = self.links().select(F.explode(F.array("a", "b")).alias("v"))
        if self.extra is not None:
            ends = ends.unionByName(self.extra.select(F.col(self.extra.columns[0]).cast("long").alias("v")).where("v is not null"))
        return ends.distinct().select("v", F.lit((1 << self.dims) - 1).alias("dims"))

    def decoded(self, df: DataFrame, *columns: str) -> DataFrame:
        """Engine numbers in `columns` as (side, id) for a bipartite graph: column x gives x_side and x. Others stay as they are."""
        if self.kind != "bipartite":
            return df
        for c in columns:
            df = df.withColumn(f"{c}_side", side_of(F.col(c))).withColumn(c, id_of(F.col(c)))
        return df

    # Accessors

    def degrees(self) -> DataFrame:
        """(dim, v, degree) of vertices with a neighbour."""
        return self.arcs().groupBy("dim", "v").agg(F.count("*").alias("degree"))

    def adjacency(self) -> DataFrame:
        """(dim, v, neighbours): sorted neighbour arrays."""
        return self.arcs().groupBy("dim", "v").agg(F.sort_array(F.collect_list("nbr")).alias("neighbours"))

    def max_degrees(self) -> DataFrame:
        return self.degrees().groupBy("dim").agg(F.max("degree").alias("max_degree"))

    def sizes(self) -> DataFrame:
        """One row: vertices bound by each coordinate alone (left and right of a bipartite graph), all vertices, and edges."""
        own = [F.count_if(F.col("dims").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n_{i}") for i in range(self.dims)]
        return self.vertices().agg(*own, F.count("*").alias("n_vertices")).crossJoin(self.edges.agg(F.count("*").alias("n_edges")))

    def has_edges(self, asked: DataFrame) -> DataFrame:
        """The rows of `asked` (the model's edge columns) that are edges."""
        return asked.join(self.edges, self.edges.columns, "left_semi")

    def with_edges(self, added: DataFrame) -> Graph:
        return self._same(self.edges.unionByName(added.select(*self.edges.columns)))

    def without_edges(self, removed: DataFrame) -> Graph:
        """Vertices that lose all edges stay as vertices, but for bipartite graphs."""
        kept = self.edges.join(removed.select(*self.edges.columns).distinct(), self.edges.columns, "left_anti")
        return self._same(kept, keep=True)

    def _same(self, edges: DataFrame, keep: bool = False) -> Graph:
        extra = self.vertices().select("v") if keep and self.kind != "bipartite" else self.extra
        if self.kind == "directed":
            return directed(edges, extra)
        if self.kind == "bipartite":
            return bipartite(edges)
        out = multilayer(edges, extra, layer="dim", layer_order=tuple(range(self.dims)))
        return Graph(out.kind, out.edges, out.extra, self.dims, self.layers)


def side_of(code: Column) -> Column:
    return F.when(code >= RIGHT // 2, F.lit("V")).otherwise(F.lit("U"))


def id_of(code: Column) -> Column:
    return F.when(code >= RIGHT // 2, code - RIGHT).otherwise(code)


def validate(edges: DataFrame, *columns: str) -> None:
    """Raise ValueError if a named column holds a null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    if not edges.where(missing).isEmpty():
        raise ValueError(f"null in {', '.join(columns)}")


def directed(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst") -> Graph:
    """Thresholds (k, l): in-degree and out-degree."""
    narrow = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    return Graph("directed", narrow.where("src <> dst").distinct(), vertices, 2)


def bipartite(edges: DataFrame, u: str = "u", v: str = "v") -> Graph:
    """Thresholds (alpha, beta): degrees of left and of right vertices."""
    narrow = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    return Graph("bipartite", narrow.where("u is not null and v is not null").distinct(), None, 2)


def multilayer(edges: DataFrame, vertices: DataFrame | None = None, layer: str = "layer", a: str = "a", b: str = "b", layer_order: tuple | None = None) -> Graph:
    """Thresholds (k_1, ..., k_D): degrees by layer, in layer_order (by default the sorted distinct layers, which are collected)."""
    if layer_order is None:
        layer_order = tuple(r[0] for r in edges.where(F.col(layer).isNotNull()).select(layer).distinct().orderBy(layer).collect())
    index = F.array_position(F.array(*[F.lit(x) for x in layer_order]), F.col(layer)).cast("int") - 1 if layer_order else F.lit(-1)
    narrow = edges.select(index.alias("dim"), F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    return Graph("multilayer", narrow.where("dim >= 0 and whole and a <> b").drop("whole").distinct(), vertices, len(layer_order), layer_order)


def edge_counts(graph: Graph) -> DataFrame:
    """(dim, n_edges) for each layer, and with dim null for all together."""
    if graph.kind != "multilayer":
        return graph.edges.agg(F.count("*").alias("n_edges")).select(F.lit(None).cast("int").alias("dim"), "n_edges")
    return graph.edges.rollup("dim").agg(F.count("*").alias("n_edges"))
