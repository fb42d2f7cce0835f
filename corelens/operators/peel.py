"""Core members: the largest vertex set in which every vertex meets a threshold vector.

`rounds` drops violating vertices in DataFrame joins, round after round, with every round written to the shared folder.
`one_task` does the same with a queue over arrays inside one task; `auto` takes it for graphs whose edge count is below a limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.operators.graphs import RIGHT, Graph
from corelens.session import discard, written

#: Edges up to which one task peels a graph.
ONE_TASK_EDGES = 2_000_000


def thresholds(graph: Graph, t: Sequence[int]) -> tuple[int, ...]:
    """t as non-negative integers; ValueError for another length or type."""
    if len(t) != graph.dims or any(isinstance(x, bool) or not isinstance(x, (int, np.integer)) for x in t):
        raise ValueError(f"{graph.dims} integers are needed, not {t!r}")
    return tuple(max(graph.base, int(x)) for x in t)


class Arrays:
    """A graph's arcs as arrays over dense vertex numbers, grouped by the neighbour they count."""

    def __init__(self, ids: np.ndarray, dims_of: np.ndarray, dim: np.ndarray, v: np.ndarray, nbr: np.ndarray, dims: int):
        order = np.argsort(ids)
        self.ids, dims_of = ids[order], dims_of[order]
        self.n, self.dims = len(ids), dims
        v, nbr = np.searchsorted(self.ids, v), np.searchsorted(self.ids, nbr)
        by = np.argsort(nbr, kind="stable")
        self.dim, self.v, self.nbr = dim[by].astype(np.int64), v[by], nbr[by]
        self.first = np.searchsorted(self.nbr, np.arange(self.n + 1))
        self.bound = (dims_of[None, :] >> np.arange(dims)[:, None]) & 1 == 1
        self.degree = np.bincount(self.dim * self.n + self.v, minlength=dims * self.n).reshape(dims, self.n) if self.n else np.zeros((dims, 0), np.int64)

    def _arcs_of(self, gone: np.ndarray) -> np.ndarray:
        size = self.first[gone + 1] - self.first[gone]
        begin = np.repeat(self.first[gone] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return begin + np.arange(size.sum())

    def peel(self, alive: np.ndarray, degree: np.ndarray, t: Sequence[int], which: np.ndarray | None = None) -> np.ndarray:
        """Drop violators of t until none is left; changes alive and degree in place and returns the dropped vertices."""
        need = np.asarray(t)[:, None]
        look = np.flatnonzero(alive) if which is None else which
        dropped = []
        while True:
            gone = look[alive[look] & ((degree[:, look] < need) & self.bound[:, look]).any(axis=0)]
            if not len(gone):
                return np.concatenate(dropped) if dropped else gone
            alive[gone] = False
            dropped.append(gone)
            arcs = self._arcs_of(gone)
            np.subtract.at(degree.reshape(-1), self.dim[arcs] * self.n + self.v[arcs], 1)
            look = np.unique(self.v[arcs])

    def core(self, t: Sequence[int]) -> np.ndarray:
        """The members of the core of t, as booleans."""
        alive = np.ones(self.n, bool)
        self.peel(alive, self.degree.copy(), t)
        return alive

    def last_values(self, prefix: Sequence[int], base: int) -> np.ndarray:
        """For each vertex the largest last coordinate l with the vertex in the core of (prefix, l); -1 where there is none."""
        alive, degree = np.ones(self.n, bool), self.degree.copy()
        last = np.full(self.n, -1, np.int64)
        self.peel(alive, degree, [*prefix, base])
        l = base
        while alive.any():
            binding = alive & self.bound[-1]
            if not binding.any():
                last[alive] = l
                return last
            l = max(l, int(degree[-1][binding].min()))
            gone = self.peel(alive, degree, [*prefix, l + 1], np.flatnonzero(binding & (degree[-1] <= l)))
            last[gone] = l
            l += 1
        return last


#: Arcs that a peel follows at a time.
ARCS_AT_ONCE = 4_000_000


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct values of all columns, and each column as places in them: by a direct table where values lie close together."""
    full = [c for c in columns if len(c)]
    if not full:
        return np.empty(0, np.int64), [c.astype(np.int32) for c in columns]
    low, high = min(int(c.min()) for c in full), max(int(c.max()) for c in full)
    if high - low <= 4 * sum(map(len, full)) + (1 << 20):
        seen = np.zeros(high - low + 1, bool)
        for c in full:
            seen[c - low] = True
        place = np.cumsum(seen, dtype=np.int32) - np.int32(1)
        return np.flatnonzero(seen) + low, [place[c - low] if len(c) else c.astype(np.int32) for c in columns]
    ids = np.unique(np.concatenate(full)).astype(np.int64)
    return ids, [np.searchsorted(ids, c).astype(np.int32) for c in columns]


def _grouped(n: int, by: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, others): the others of each number of `by`, one after the other, and where each number's begin."""
    packed = by.astype(np.int64)
    packed <<= 32
    packed |= other
    packed.sort()
    first = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=n))])
    return first, packed.astype(np.int32)  # the low half


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each vertex's smallest fellow) after the links a-b too."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := label[label], label):
            label = shorter
    return label


class CompactArrays:
    """A graph that a task reads for itself: per coordinate, the vertices that lose a neighbour when one goes, in 4 bytes an arc."""

    def __init__(self, kind: str, dims: int, batches: Iterator[pa.RecordBatch], links: bool = False):
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            dim, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            b = b - RIGHT if kind == "bipartite" else b
            parts.append((dim.astype(np.int8), *(c.astype(np.int32) if len(c) and c.min() >= -(1 << 31) and c.max() < 1 << 31 else c.copy() for c in (a, b))))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3)]
        parts.clear()
        dim, a, b = columns
        columns.clear()
        self.kind, self.dims = kind, dims
        if kind == "bipartite":
            left, (a,) = _dense(a)
            right, (b,) = _dense(b)
            self.ids, b = np.concatenate([left, right + RIGHT]), b + np.int32(len(left))
        else:
            self.ids, (a, b) = _dense(a, b)
            edge = dim >= 0
            if not edge.all():
                dim, a, b = dim[edge], a[edge], b[edge]
        self.n = n = len(self.ids)
        self.links = (a, b) if links else None
        if kind == "multilayer":
            ends = [(a[dim == i], b[dim == i]) for i in range(dims)]
            self.arcs = [_grouped(n, np.concatenate([x, y]), np.concatenate([y, x])) for x, y in ends]
        else:  # directed a -> b: b has a as in-neighbour, a has b as out-neighbour; bipartite: left a, right b
            self.arcs = [_grouped(n, a, b), _grouped(n, b, a)]
            if kind == "bipartite":
                self.arcs.reverse()
        self.degree = np.stack([np.bincount(counted, minlength=n).astype(np.int32) for _, counted in self.arcs])
        self.bound_last = np.ones(n, bool)
        if kind == "bipartite":  # what doesn't bind never falls short
            self.bound_last[: len(left)] = False
            self.degree[0, len(left) :] = self.degree[1, : len(left)] = np.iinfo(np.int32).max

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(self.n, bool), self.degree.copy()

    def peel(self, state: tuple[np.ndarray, np.ndarray], t: Sequence[int], look: np.ndarray | None = None) -> np.ndarray:
        """Drop violators of t until none is left; changes the state in place and returns the dropped vertices."""
        alive, degree = state
        look, dropped = np.flatnonzero(alive) if look is None else look, []
        while True:
            look = look[alive[look]]
            bad = np.zeros(len(look), bool)
            for i, x in enumerate(t):
                bad |= degree[i][look] < x
            gone = np.unique(look[bad])
            if not len(gone):
                return np.concatenate(dropped) if dropped else gone
            alive[gone] = False
            dropped.append(gone)
            touched = []
            for i, (first, counted) in enumerate(self.arcs):
                size = first[gone + 1] - first[gone]
                ends = np.cumsum(size)
                cuts = np.unique(np.searchsorted(ends, np.arange(ARCS_AT_ONCE, int(ends[-1]), ARCS_AT_ONCE)))
                for some, sizes in zip(np.split(gone, cuts), np.split(size, cuts), strict=True):
                    if not (total := int(sizes.sum())):
                        continue
                    at = np.repeat(first[some] - (np.cumsum(sizes) - sizes), sizes)
                    at += np.arange(total)
                    hit = counted[at].astype(np.int64)
                    if total > self.n // 8:
                        degree[i] -= np.bincount(hit, minlength=self.n).astype(np.int32)
                    else:
                        np.subtract.at(degree[i], hit, np.int32(1))
                    touched.append(hit if total <= self.n // 8 else None)
            whole = any(x is None for x in touched) or sum(map(len, touched)) > self.n // 4
            look = np.flatnonzero(alive) if whole else np.concatenate(touched) if touched else gone[:0]

    def last_values(self, state: tuple[np.ndarray, np.ndarray], prefix: Sequence[int], base: int) -> np.ndarray:
        """As Arrays.last_values, from the state of the core of (prefix, base), which it uses up."""
        alive, degree = state
        last = np.full(self.n, -1, np.int32)
        l = base
        left = np.flatnonzero(alive)
        while len(left := left[alive[left]]):
            binding = left[self.bound_last[left]]
            if not len(binding):
                last[left] = l
                return last
            d = degree[-1][binding]
            l = max(l, int(d.min()))
            last[self.peel(state, [*prefix, l + 1], binding[d <= l])] = l
            l += 1
        return last

    def walk(self, state: tuple[np.ndarray, np.ndarray], prefix: tuple[int, ...], base: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """(prefix, last values) of all prefixes with a member that begin as given; state: the core of the given ones and base in the others."""
        if not state[0].any():
            return
        if len(prefix) == self.dims - 1:
            yield prefix, self.last_values((state[0].copy(), state[1].copy()), prefix, base)
            return
        state, k = (state[0].copy(), state[1].copy()), base
        while state[0].any():
            yield from self.walk(state, (*prefix, k), base)
            k += 1
            self.peel(state, [*prefix, k, *[base] * (self.dims - len(prefix) - 1)])


def settled(graph: Graph) -> Graph:
    """The graph with its edges in a written table, so that they are made once and counted from metadata."""
    if getattr(graph.edges, "written_path", None):
        return graph
    return Graph(graph.kind, written(graph.edges, "edges"), graph.extra, graph.dims, graph.layers)


def flat(graph: Graph) -> DataFrame:
    """(dim, a, b): a row for each edge in engine numbers, and with dim -1 for each extra vertex."""
    if graph.kind == "multilayer":
        rows = graph.edges.select("dim", "a", "b")
    else:
        ends = ("src", F.col("dst")) if graph.kind == "directed" else ("u", F.col("v") + F.lit(RIGHT))
        rows = graph.edges.select(F.lit(0).alias("dim"), F.col(ends[0]).alias("a"), ends[1].alias("b"))
    if graph.extra is None:
        return rows
    v = F.col(graph.extra.columns[0]).cast("long")
    return rows.unionByName(graph.extra.where(v.isNotNull()).select(F.lit(-1).alias("dim"), v.alias("a"), v.alias("b")))


def arrays_from(kind: str, dims: int, dim: np.ndarray, a: np.ndarray, b: np.ndarray) -> Arrays:
    """Arrays of the rows of flat()."""
    ids = np.unique(np.concatenate([a, b])).astype(np.int64)
    edge = dim >= 0
    dim, a, b = dim[edge], a[edge], b[edge]
    if kind == "directed":  # a -> b: a counts for b's in-degree, b for a's out-degree
        parts = (np.zeros(len(a), np.int64), b, a), (np.ones(len(a), np.int64), a, b)
    elif kind == "bipartite":
        parts = (np.zeros(len(a), np.int64), a, b), (np.ones(len(a), np.int64), b, a)
    else:
        parts = (dim, a, b), (dim, b, a)
    bits = np.where(ids >= RIGHT // 2, 2, 1) if kind == "bipartite" else np.full(len(ids), (1 << dims) - 1)
    return Arrays(ids, bits, *(np.concatenate(x) for x in zip(*parts, strict=True)), dims)


def _one_task(graph: Graph, t: tuple[int, ...]) -> DataFrame:
    kind, dims = graph.kind, graph.dims

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 3
        found = arrays_from(kind, dims, *columns)
        yield pa.RecordBatch.from_arrays([pa.array(found.ids[found.core(t)], pa.int64())], names=["v"])

    return flat(graph).coalesce(1).mapInArrow(members, "v long")


def _rounds(graph: Graph, t: tuple[int, ...]) -> DataFrame:
    alive, arcs = written(graph.vertices(), "alive"), written(graph.arcs(), "arcs")
    left = alive.count()
    fine = F.lit(True)
    for i, x in enumerate(t):
        if x:
            fine = fine & ((F.col("dims").bitwiseAND(F.lit(1 << i)) == 0) | (F.coalesce(f"d{i}", F.lit(0)) >= x))
    while True:
        near = arcs.join(alive.select("v"), "v", "left_semi").join(alive.select(F.col("v").alias("nbr")), "nbr", "left_semi")
        arcs_now = written(near, "arcs")
        degree = arcs_now.groupBy("v").agg(*[F.count_if(F.col("dim") == i).alias(f"d{i}") for i in range(graph.dims)])
        now = written(alive.join(degree, "v", "left").where(fine).select("v", "dims"), "alive")
        n = now.count()
        discard(arcs, alive)
        arcs, alive = arcs_now, now
        if n == left:
            discard(arcs)
            return alive.select("v")
        left = n


def core_members(graph: Graph, t: Sequence[int], engine: str = "auto") -> DataFrame:
    """(v) of the core of t, in engine numbers; a threshold above all cores gives no rows."""
    t = thresholds(graph, t)
    if engine == "auto":
        graph = settled(graph)
        engine = "one_task" if graph.edges.count() <= ONE_TASK_EDGES else "rounds"
    if engine not in ("one_task", "rounds"):
        raise ValueError(f"unknown engine {engine!r}")
    return _one_task(graph, t) if engine == "one_task" else _rounds(graph, t)


def induced_links(graph: Graph, members: DataFrame) -> DataFrame:
    """The graph's links with both ends among the members."""
    m = members.select("v")
    return graph.links().join(m.withColumnRenamed("v", "a"), "a", "left_semi").join(m.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
