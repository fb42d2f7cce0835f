"""Text formats of graphs, skylines, frontiers and update batches as DataFrames, and Parquet for everything else.

Formats (numbers divided by blanks):

* directed graph: a line with the number of vertices, then `id nbr nbr ...` (out-neighbours); degrees: `id in out`;
* bipartite graph: `u v` a line; its counts: two lines;
* multilayer graph: `layers vertices largest_id`, then `layer from to`;
* skylines: a line with the number of records, then `k l m v1 .. vm`, or `a b nU u.. nV v..`, or D coordinates, m and ids;
* frontiers: `k l_max`; for bipartite graphs the second number is the maximum plus one; for multilayer graphs a line with the index of the free coordinate, then prefix and maximum;
* update batches: `A:` or `D:` with the ends of edges, then `id:(x,y)(x,y)|(x,y)`, a vertex with its new and its old skyline, up to a blank line.

Malformed lines of the bipartite reader raise; other readers skip lines that have no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelens.operators import graphs
from corelens.operators.graphs import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, t): lines in file order, with their numbers as an array."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return text.select("file", "block", "at", "value", F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("words"))


def _numbers(lines: DataFrame, kind: str = "bigint") -> DataFrame:
    return lines.where(F.trim("value").rlike("^[-0-9]")).withColumn("t", F.col("words").cast(f"array<{kind}>")).drop("words", "value")


def _without_header(lines: DataFrame) -> DataFrame:
    """Drop the first line of each file."""
    first = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    return lines.join(F.broadcast(first), ["file", "at"], "left_anti")


def read_directed(spark: SparkSession, path: str) -> Graph:
    rows = _without_header(_numbers(_lines(spark, path)))
    edges = rows.select(F.get("t", F.lit(0)).alias("src"), F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("dst"))
    return graphs.directed(edges, rows.select(F.get("t", F.lit(0)).alias("id")))


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(_lines(spark, path)).select(F.get("t", F.lit(0)).alias("id"), F.get("t", F.lit(1)).alias("in_degree"), F.get("t", F.lit(2)).alias("out_degree"))


def read_bipartite(spark: SparkSession, path: str) -> Graph:
    edges = spark.read.csv(path, sep=" ", schema="u long, v long", mode="FAILFAST")
    return graphs.bipartite(edges)


def read_bipartite_counts(spark: SparkSession, path: str) -> tuple[int, int]:
    found = [r["t"][0] for r in _numbers(_lines(spark, path)).orderBy("at").limit(2).collect()]
    if len(found) != 2:
        raise ValueError(f"two counts are needed in {path}")
    return found[0], found[1]


def read_multilayer(spark: SparkSession, path: str, layer_order: tuple | None = None) -> Graph:
    rows = _without_header(_numbers(_lines(spark, path)))
    edges = rows.select(F.get("t", F.lit(0)).alias("layer"), F.get("t", F.lit(1)).alias("a"), F.get("t", F.lit(2)).alias("b"))
    return graphs.multilayer(edges, layer_order=layer_order)


def read_skyline(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    """(c0, ..., v) of a directed or multilayer skyline."""
    rows = _without_header(_numbers(_lines(spark, path)))
    members = F.slice("t", F.lit(dims + 2), F.get("t", F.lit(dims)).cast("int"))
    return rows.select(*[F.get("t", F.lit(i)).cast("int").alias(f"c{i}") for i in range(dims)], F.explode(members).alias("v"))


def read_bipartite_skyline(spark: SparkSession, path: str) -> DataFrame:
    """(c0, c1, v) with right vertices in engine numbers."""
    rows = _without_header(_numbers(_lines(spark, path)))
    left = F.slice("t", F.lit(4), F.get("t", F.lit(2)).cast("int"))
    right = F.expr(f"transform(slice(t, cast(get(t, 2) as int) + 5, cast(get(t, cast(get(t, 2) as int) + 3) as int)), x -> x + {graphs.RIGHT})")
    return rows.select(F.get("t", F.lit(0)).cast("int").alias("c0"), F.get("t", F.lit(1)).cast("int").alias("c1"), F.explode(F.concat(left, right)).alias("v"))


def read_frontier(spark: SparkSession, path: str, plus_one: bool = False) -> DataFrame:
    """(c0, max_last); plus_one for the bipartite format."""
    return _numbers(_lines(spark, path)).select(F.get("t", F.lit(0)).cast("int").alias("c0"), (F.get("t", F.lit(1)) - int(plus_one)).cast("int").alias("max_last"))


def read_multilayer_frontier(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, max_last, free): free is the index of the coordinate whose maximum is given."""
    lines = _numbers(_lines(spark, path), "int")
    first = lines.where("block = 0").groupBy("file").agg(F.get(F.min_by("t", "at"), F.lit(0)).alias("free"))
    return _without_header(lines).join(F.broadcast(first), "file").select(F.slice("t", F.lit(1), F.size("t") - 1).alias("prefix"), F.get("t", F.size("t") - 1).alias("max_last"), "free")


def read_updates(spark: SparkSession, path: str, edge_width: int = 2) -> tuple[DataFrame, DataFrame]:
    """(batch, op, ends) of every edge and (batch, vertex, coordinate, state) of the skylines given for it, state new or old.

    edge_width: numbers of an edge, 3 for multilayer graphs (from, to, layer). A file's lines have to be read in order, so one file is one group.
    """
    order = Window.partitionBy("file").orderBy("k")
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    ended = F.max((F.trim("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("ended", ended).where("ended = 0").withColumn("head", F.regexp_extract("line", "^\\s*([AD])[^:]*:", 1))
    lines = lines.withColumn("batch", F.sum((F.col("head") != "").cast("int")).over(order) - 1)
    numbers: Column = F.transform(F.regexp_extract_all(F.substring_index("line", ":", -1), F.lit("-?\\d+"), F.lit(0)), lambda x: x.cast("long"))
    heads = lines.where("head <> ''").select("batch", F.col("head").alias("op"), numbers.alias("n"))
    each = F.transform(F.sequence(F.lit(0), F.expr(f"size(n) div {edge_width} - 1")), lambda i: F.slice(F.col("n"), i * edge_width + 1, F.lit(edge_width)))
    edges = heads.where(F.size("n") >= edge_width).select("batch", "op", F.explode(each).alias("ends"))
    points = lambda side: F.transform(F.regexp_extract_all(side, F.lit("\\(([^)]*)\\)"), F.lit(1)), lambda p: F.split(F.regexp_replace(p, "\\s", ""), ",").cast("array<int>"))
    tail = F.regexp_extract("line", "^[^:]*:(.*)$", 1)
    body = lines.where("head = '' and line like '%:%'").select("batch", F.regexp_extract("line", "^\\s*(-?\\d+)", 1).cast("long").alias("vertex"), F.split_part(tail, F.lit("|"), F.lit(1)).alias("new"), F.split_part(tail, F.lit("|"), F.lit(2)).alias("old"))
    states = F.array(F.struct(F.lit("new").alias("state"), points(F.col("new")).alias("p")), F.struct(F.lit("old").alias("state"), points(F.col("old")).alias("p")))
    deltas = body.select("batch", "vertex", F.explode(states).alias("s")).select("batch", "vertex", F.explode("s.p").alias("coordinate"), F.col("s.state").alias("state"))
    return edges, deltas
