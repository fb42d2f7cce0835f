"""Full decomposition: the largest last coordinate of every vertex for every prefix, skylines and frontiers.

For a prefix (all coordinates but the last) cores shrink as the last coordinate grows, so one pass of a bucket peel gives each
vertex its last value. Prefixes are independent rows of work: they are dealt to tasks, which hold the graph as
arrays. Below ARRAY_EDGES edges the arrays are broadcast; up to TASK_EDGES each task reads the written edges itself and takes a
run of first coordinates, so that the driver never holds the graph; above it `row_values` peels prefix by prefix with DataFrame
rounds instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelens.operators.graphs import Graph
from corelens.operators.peel import Arrays, CompactArrays, arrays_from, core_members, flat, settled
from corelens.session import written

#: Edges up to which a graph's arrays are broadcast.
ARRAY_EDGES = 4_000_000
#: Edges up to which each of a few tasks holds the graph, at about 8 bytes an edge and 24 while it reads.
TASK_EDGES = 64_000_000
#: Rows of an Arrow batch of results.
ROWS_AT_ONCE = 500_000


def shared_arrays(graph: Graph):
    """The graph's arrays, broadcast; None above the limit."""
    graph = settled(graph)
    if graph.edges.count() > ARRAY_EDGES:
        return None
    rows = flat(graph).toArrow()
    found = arrays_from(graph.kind, graph.dims, *(c.to_numpy() for c in rows.columns))
    return graph.edges.sparkSession.sparkContext.broadcast(found)


def _prefix_rows(spark, prefixes: list[tuple[int, ...]], width: int) -> DataFrame:
    schema = ", ".join(["i long", *(f"c{k} int" for k in range(width))])
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(prefixes)], schema)
    return rows.repartition(max(1, min(len(prefixes), 4 * spark.sparkContext.defaultParallelism)), "i").drop("i")


def _values_schema(width: int) -> str:
    return ", ".join([*(f"c{k} int" for k in range(width)), "v long", "last int"])


def _rows_for(graph: Graph, shared, prefixes: list[tuple[int, ...]]) -> DataFrame:
    width, base = graph.dims - 1, graph.base

    def peeled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Arrays = shared.value
        for pdf in batches:
            for prefix in pdf.itertuples(index=False):
                last = found.last_values(tuple(prefix), base)
                here = np.flatnonzero(last >= 0)
                yield pd.DataFrame({**{f"c{k}": np.full(len(here), p, "int32") for k, p in enumerate(prefix)}, "v": found.ids[here].astype("int64"), "last": last[here].astype("int32")})

    spark = graph.edges.sparkSession
    if width == 0:
        return spark.range(1).select("id").mapInPandas(lambda it: (pd.DataFrame({"v": shared.value.ids[x >= 0].astype("int64"), "last": x[x >= 0].astype("int32")}) for _ in it for x in [shared.value.last_values((), base)]), _values_schema(0))
    return _prefix_rows(spark, prefixes, width).mapInPandas(peeled, _values_schema(width))


def _dealt(graph: Graph, firsts: list[int], counts: dict[int, int]) -> list[list[int]]:
    """Runs of first coordinates, one a task, of about equal work: arcs of vertices that have the degree; counts: vertices by degree."""
    work = [1 + sum(d * n for d, n in counts.items() if d >= k) for k in firsts]
    tasks = max(1, min(len(firsts), graph.edges.sparkSession.sparkContext.defaultParallelism))
    out: list[list[int]] = [[] for _ in range(tasks)]
    done = 0
    for k, w in zip(firsts, work, strict=True):
        out[min(tasks - 1, int((done + w / 2) * tasks / sum(work)))].append(k)
        done += w
    return [x for x in out if x]


def _by_tasks(graph: Graph, prefixes: list[tuple[int, ...]] | None, sky: bool = False) -> DataFrame:
    """Rows for the prefixes (None: all with a member), or with sky the skyline's points alone: each task reads the graph and takes a run of first coordinates."""
    graph = settled(graph)
    kind, dims, base = graph.kind, graph.dims, graph.base
    counts = dict(graph.degrees().where("dim = 0").groupBy("degree").agg(F.count("*")).collect())
    if prefixes is None:
        firsts = list(range(base, max([base, *counts]) + 1))
    else:
        firsts = sorted({p[0] for p in prefixes})

    def batches_of(found: CompactArrays, prefix: tuple[int, ...], last: np.ndarray, here: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(here), ROWS_AT_ONCE):
            some = here[at : at + ROWS_AT_ONCE]
            columns = [*(pa.array(np.full(len(some), p, np.int32)) for p in prefix), pa.array(found.ids[some], pa.int64()), pa.array(last[some])]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{k}" for k in range(dims - 1)), "v", "last"])

    def given(found: CompactArrays, mine: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
        state, before = found.start(), (base,) * (dims - 1)
        for prefix in mine:
            if any(x < y for x, y in zip(prefix, before, strict=True)):
                state = found.start()
            found.peel(state, [*prefix, base])
            last = found.last_values((state[0].copy(), state[1].copy()), prefix, base)
            yield from batches_of(found, prefix, last, np.flatnonzero(last >= 0))
            before = prefix

    def every(found: CompactArrays, run: list[int]) -> Iterator[pa.RecordBatch]:
        state, below = found.start(), None
        for k in [*run, run[-1] + 1] if sky else run:
            found.peel(state, [k, *[base] * (dims - 1)])
            if not sky:
                for prefix, last in found.walk(state, (k,), base):
                    yield from batches_of(found, prefix, last, np.flatnonzero(last >= 0))
                continue
            now = dict(found.walk(state, (k,), base))
            for prefix, last in (below or {}).items():
                # Values fall along each coordinate, so a point is maximal if they do at each next prefix.
                best = last >= 0
                for i in range(dims - 1):
                    after = (*prefix[:i], prefix[i] + 1, *prefix[i + 1 :])
                    if (other := (now if i == 0 else below).get(after)) is not None:
                        best &= other < last
                yield from batches_of(found, prefix, last, np.flatnonzero(best))
            below = now

    def task(run: list[int]):
        mine = None if prefixes is None else [p for p in prefixes if p[0] in set(run)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = CompactArrays(kind, dims, batches)
            yield from every(found, run) if mine is None else given(found, mine)

        return work

    # Else Spark runs a union of single partitions as one task.
    graph.edges.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = None
    for run in _dealt(graph, firsts, counts):
        part = flat(graph).coalesce(1).mapInArrow(task(run), _values_schema(dims - 1))
        out = part if out is None else out.unionByName(part)
    return out


def _in_tasks(graph: Graph) -> bool:
    return graph.dims > 1 and ARRAY_EDGES < graph.edges.count() <= TASK_EDGES


def _by_rounds(graph: Graph, prefixes: list[tuple[int, ...]]) -> DataFrame:
    out = None
    for prefix in prefixes:
        l, kept = graph.base, None
        while not (now := core_members(graph, (*prefix, l), "rounds")).isEmpty():
            at = now.select(*[F.lit(p).cast("int").alias(f"c{k}") for k, p in enumerate(prefix)], "v", F.lit(l).cast("int").alias("last"))
            kept = at if kept is None else kept.unionByName(at)
            l += 1
        if kept is not None:
            best = kept.groupBy(*graph.prefix_columns, "v").agg(F.max("last").alias("last"))
            out = best if out is None else out.unionByName(best)
    return out if out is not None else graph.edges.sparkSession.createDataFrame([], _values_schema(graph.dims - 1))


def row_values(graph: Graph, prefixes: list[tuple[int, ...]] | None = None, engine: str = "auto") -> DataFrame:
    """(c0, ..., v, last): the last value of every vertex in every prefix (all that have a member, unless given).

    Prefixes are found breadth-first: one has members only if those below it in each coordinate have.
    """
    if engine not in ("auto", "arrays", "tasks", "rounds"):
        raise ValueError(f"unknown engine {engine!r}")
    graph = settled(graph)
    width = graph.dims - 1
    in_tasks = width > 0 and (engine == "tasks" or (engine == "auto" and _in_tasks(graph)))
    if in_tasks and prefixes is None:
        return _by_tasks(graph, None)
    shared = None if in_tasks or engine == "rounds" else shared_arrays(graph)
    rows_of = (lambda p: _by_tasks(graph, p)) if in_tasks else (lambda p: _rows_for(graph, shared, p)) if shared is not None else (lambda p: _by_rounds(graph, p))
    if prefixes is not None:
        if prefixes and any(len(p) != width for p in prefixes):
            raise ValueError(f"a prefix has {width} coordinates")
        return rows_of(sorted(set(prefixes))) if prefixes else graph.edges.sparkSession.createDataFrame([], _values_schema(width))
    if width == 0:
        return rows_of([()])
    if width == 1:  # a chain: double the reach until the end shows
        top = graph.degrees().where("dim = 0").agg(F.max("degree")).first()[0] or 0
        if shared is not None:
            low, high = graph.base, top
            while low < high:  # the largest prefix with a member
                middle = (low + high + 1) // 2
                low, high = (middle, high) if shared.value.core((middle, graph.base)).any() else (low, middle - 1)
            top = low
        return rows_of([(k,) for k in range(graph.base, top + 1)])
    wave, known, parts = [(graph.base,) * width], set(), []
    while wave:
        part = written(rows_of(wave), "rows")
        parts.append(part)
        full = {tuple(r) for r in part.select(*graph.prefix_columns).distinct().collect()}
        known |= full
        grown = {(*p[:k], p[k] + 1, *p[k + 1 :]) for p in full for k in range(width)}
        wave = sorted(p for p in grown if all(p[k] <= graph.base or (*p[:k], p[k] - 1, *p[k + 1 :]) in known for k in range(width)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def skyline(graph: Graph, rows: DataFrame | None = None) -> DataFrame:
    """(c0, ..., c{D-1}, v): the maximal coordinates of each vertex."""
    if rows is None:
        graph = settled(graph)
        if _in_tasks(graph):
            return _by_tasks(graph, None, sky=True).withColumnRenamed("last", f"c{graph.dims - 1}").select(*graph.coordinates, "v")
        rows = row_values(graph)
    points = rows.withColumnRenamed("last", f"c{graph.dims - 1}").select(*graph.coordinates, "v")
    return maximal(points, graph.coordinates)


def maximal(points: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """Per vertex v, the points that no other point of the vertex dominates."""
    if len(coordinates) == 1:
        return points.groupBy("v").agg(F.max(coordinates[0]).alias(coordinates[0])).select(*coordinates, "v")
    if len(coordinates) == 2:
        x, y = coordinates
        best = points.groupBy("v", x).agg(F.max(y).alias(y))
        above = Window.partitionBy("v").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
        return best.withColumn("above", F.max(y).over(above)).where(f"above is null or {y} > above").select(*coordinates, "v")
    points = points.distinct()
    other = points.select(F.col("v").alias("_v"), *[F.col(c).alias(f"_{c}") for c in coordinates])
    dominates = (F.col("v") == F.col("_v")) & F.expr(" and ".join(f"_{c} >= {c}" for c in coordinates)) & F.expr(" or ".join(f"_{c} > {c}" for c in coordinates))
    return points.join(other, dominates, "left_anti").select(*coordinates, "v")


def frontier(points: DataFrame, graph: Graph) -> DataFrame:
    """(prefix, max_last): for every prefix with a member, the largest last coordinate of a core; points: a skyline.

    In two dimensions a running maximum from the highest prefix down; beyond, a join with all prefixes below each point.
    """
    last = f"c{graph.dims - 1}"
    tops = points.groupBy(*graph.prefix_columns).agg(F.max(last).alias("m"))
    below = tops
    for c in graph.prefix_columns:
        below = below.withColumn(c, F.explode(F.sequence(F.lit(graph.base), F.col(c))))
    return below.groupBy(*graph.prefix_columns).agg(F.max("m").alias("max_last"))


def threshold_vectors(front: DataFrame, graph: Graph) -> DataFrame:
    """Every threshold vector with a non-empty core."""
    return front.select(*graph.prefix_columns, F.explode(F.sequence(F.lit(graph.base), F.col("max_last"))).alias(f"c{graph.dims - 1}"))


def naive_core(edges_by_dim: list[dict], bound: dict, t: Sequence[int]) -> set:
    """The core by definition, for tests: edges_by_dim[d][v] is the set of neighbours, bound[v] the coordinates that bind v."""
    alive = set(bound)
    while True:
        bad = {v for v in alive for d in bound[v] if len(edges_by_dim[d].get(v, set()) & alive) < t[d]}
        if not bad:
            return alive
        alive -= bad


