"""Query workloads: sweeps along one coordinate, seeded random thresholds, and timed runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelens.operators.graphs import Graph
from corelens.plans.blocks import numbered


def sweep(spark: SparkSession, fixed: Sequence[int | None], values: Sequence[int]) -> DataFrame:
    """(qid, c0, ...): the one coordinate that is None takes each of the values."""
    if sum(x is None for x in fixed) != 1:
        raise ValueError("one coordinate must be free")
    rows = [(q, *(value if x is None else x for x in fixed)) for q, value in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join(["qid long", *(f"c{i} int" for i in range(len(fixed)))]))


#: A prime modulus and multipliers of the draws, which any SQL engine can repeat.
PRIME, FACTORS = 2_147_483_647, (48_271, 16_807, 69_621)


def _mixed(x: Column) -> Column:
    """A number below PRIME that looks random: the square of a multiple."""
    x = F.pmod(x.cast("long"), F.lit(PRIME)) * F.lit(FACTORS[0]) % F.lit(PRIME)
    return x * x % F.lit(PRIME)


def random_thresholds(vectors: DataFrame, graph: Graph, n: int, seed: int = 0) -> DataFrame:
    """(qid, c0, ...): n draws with replacement from threshold vectors, the same for the same seed."""
    ordered = numbered(vectors.select(*graph.coordinates), [F.col(c) for c in graph.coordinates], "k")
    total = ordered.count()
    if not total:
        return ordered.select(F.col("k").alias("qid"), *graph.coordinates)
    draws = vectors.sparkSession.range(n).select(F.col("id").alias("qid"), (_mixed(F.col("id") + 1 + seed * 7_919) % total).alias("k"))
    return draws.join(ordered, "k").select("qid", *graph.coordinates)


def update_batches(graph: Graph, sizes: Sequence[int] = (1, 4, 16, 64, 256, 1024), seed: int = 0) -> DataFrame:
    """(size, edge columns): for each size so many of the graph's edges, the same for the same seed."""
    edges = graph.edges
    order = _mixed(sum((F.col(c).cast("long") * f for c, f in zip(edges.columns, FACTORS)), F.lit(seed)))
    parts = [edges.orderBy(order, *edges.columns).limit(n).select(F.lit(n).alias("size"), *edges.columns) for n in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def timed(name: str, run: Callable[[], DataFrame], repeats: int = 1) -> dict:
    """Rows and mean seconds of a query's runs."""
    seconds, rows = [], 0
    for _ in range(repeats):
        began = time.perf_counter()
        rows = run().count()
        seconds.append(time.perf_counter() - began)
    return {"name": name, "rows": rows, "seconds": sum(seconds) / len(seconds), "repeats": repeats}
