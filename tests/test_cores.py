import itertools

import naive
import pytest

from corelens.operators import decompose, graphs
from corelens.operators.components import connected_components
from corelens.operators.peel import core_members, induced_links, thresholds
from corelens.plans import maintain, workload
from corelens.plans.index import CoreIndex

KINDS = ["directed", "bipartite", "multilayer"]


def build(spark, kind, edges, extra=()):
    more = spark.createDataFrame([(v,) for v in extra], "v long") if extra else None
    if kind == "directed":
        return graphs.directed(spark.createDataFrame(edges, "src long, dst long"), more)
    if kind == "bipartite":
        return graphs.bipartite(spark.createDataFrame(edges, "u long, v long"))
    return graphs.multilayer(spark.createDataFrame(edges, "layer int, a long, b long"), more, layer_order=(0, 1, 2))


def name(kind, code):
    if kind != "bipartite":
        return code
    return ("V", code - graphs.RIGHT) if code >= graphs.RIGHT // 2 else ("U", code)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("engine", ["one_task", "rounds"])
def test_members(spark, kind, engine):
    edges, extra = naive.random_graph(kind, 3)
    g = build(spark, kind, edges, extra)
    nbr, bound, _ = naive.neighbours(kind, edges, extra)
    for t in [(1, 1, 1), (2, 0, 1), (0, 2, 0), (2, 2, 2), (3, 1, 1), (9, 9, 9)] if engine == "one_task" else [(2, 2, 1), (0, 2, 0)]:
        t = thresholds(g, t[: g.dims])
        assert {name(kind, r.v) for r in core_members(g, t, engine).collect()} == naive.core(nbr, bound, t), t


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("seed", [1, 2])
def test_skyline_frontier_and_search(spark, kind, seed):
    edges, extra = naive.random_graph(kind, seed, n=12, m=45)
    g = build(spark, kind, edges, extra)
    nbr, bound, links = naive.neighbours(kind, edges, extra)
    cores = naive.all_cores(kind, nbr, bound)
    index = CoreIndex.build(g, forest=True, fanout=3)
    got = {(tuple(r[c] for c in g.coordinates), name(kind, r.v)) for r in index.skyline.collect()}
    assert got == naive.skyline(cores)
    front = decompose.frontier(index.skyline, g)
    assert {tuple(r) for r in decompose.threshold_vectors(front, g).collect()} == set(cores)
    some = [t for k, t in enumerate(sorted(cores)) if k % max(1, len(cores) // 4) == 0]
    for t in [*some[:4], (50,) * g.dims]:
        want = naive.components(cores.get(t, set()), links)
        for forest in (True, False):
            assert {name(kind, r.v): name(kind, r.component) for r in index.components(t, forest).collect()} == want
    queries = spark.createDataFrame([(k, *t) for k, t in enumerate(sorted(cores))], ", ".join(["qid long", *(f"{c} int" for c in g.coordinates)]))
    by = {}
    for r in index.batch_components(queries).collect():
        by.setdefault(r.qid, {})[name(kind, r.v)] = name(kind, r.component)
    assert by == {k: naive.components(cores[t], links) for k, t in enumerate(sorted(cores))}
    # Subgraphs and connect edges of the dominating points give the components of every core, and no threshold leaves more links open than it has to.
    coordinates = {r.core_id: tuple(r[c] for c in g.coordinates) for r in index.points.collect()}
    held, subs, opened = {}, {}, {}
    for r in index.connect_edges().collect():
        held.setdefault(r.core_id, set()).add((r.a, r.b))
    for r in index.subgraphs().collect():
        subs.setdefault((r.core_id, r.component), []).append(r.v)
    for r in index.open_links().collect():
        opened[tuple(r[c] for c in g.coordinates)] = opened.get(tuple(r[c] for c in g.coordinates), 0) + 1
    assert set().union(*held.values(), set()) <= {(r.a, r.b) for r in g.links().collect()}
    decoded = lambda pairs: [(name(kind, a), name(kind, b)) for a, b in pairs]
    stars = {c: [(own[0], v) for (q, _), own in subs.items() if q == c for v in own] for c in coordinates}
    for t, members in cores.items():
        above = [c for c, at in coordinates.items() if all(x >= y for x, y in zip(at, t, strict=True))]
        pairs = [p for c in above for p in [*decoded(stars[c]), *decoded(held.get(c, ()))] if set(p) <= members]
        parts = naive.components(members, links)
        assert naive.components(members, pairs) == parts, t
        known = [p for i in range(g.dims) for p in links if set(p) <= cores.get((*t[:i], t[i] + 1, *t[i + 1 :]), set())]
        known += [p for c, at in coordinates.items() if at == t for p in decoded(stars[c])]
        assert opened.get(t, 0) == len(set(naive.components(members, known).values())) - len(set(parts.values())), t
    bare = CoreIndex.from_rows(g, index.rows, False, 3)
    assert {tuple(r) for r in bare.subgraphs().collect()} == {(c, component, v) for (c, component), own in subs.items() for v in own}
    inside = {}
    for r in index.skyline.join(index.points, g.coordinates).collect():
        inside.setdefault(r.core_id // index.fanout, set()).add(r.v)
    want = {(core_id // index.fanout, a, b) for core_id, own in held.items() for a, b in own if not {a, b} <= inside[core_id // index.fanout]}
    assert {tuple(r) for r in index.out_edges().select("block_id", "a", "b").collect()} == want


def test_decomposition_by_rounds(spark):
    edges, _ = naive.random_graph("bipartite", 5, n=7, m=20)
    g = build(spark, "bipartite", edges)
    prefixes = [(k,) for k in range(1, 5)]
    rows = lambda engine: {tuple(r) for r in decompose.row_values(g, prefixes, engine).collect()}
    assert rows("rounds") == rows("arrays")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("seed", [1, 2])
def test_update_equals_rebuild(spark, kind, seed):
    edges, extra = naive.random_graph(kind, seed, n=12, m=40)
    more, _ = naive.random_graph(kind, seed + 100, n=14, m=6)
    index = CoreIndex.build(build(spark, kind, edges, extra), forest=True)
    adds = build(spark, kind, more).edges
    deletes = index.graph.edges.orderBy(*index.graph.edges.columns).limit(5)
    gone = {tuple(r) for r in deletes.collect()}
    for a, d in [(adds, None), (None, deletes), (adds, deletes)]:
        after = maintain.apply_updates(index, a, d)
        now = [e for e in {tuple(r) for r in index.graph.edges.collect()} | ({tuple(r) for r in adds.collect()} if a is not None else set()) if d is None or e not in gone]
        nodes = {v for e in [*edges, *(more if a is not None else [])] for v in e[-2:] if e[-2] != e[-1]} if kind != "bipartite" else set()
        nbr, bound, links = naive.neighbours(kind, now, [*extra, *nodes])
        cores = naive.all_cores(kind, nbr, bound)
        got = {(tuple(r[c] for c in index.graph.coordinates), name(kind, r.v)) for r in after.skyline.collect()}
        assert got == naive.skyline(cores)
        t = sorted(cores)[len(cores) // 3]
        assert {name(kind, r.v): name(kind, r.component) for r in after.components(t).collect()} == naive.components(cores[t], links)
    delta = maintain.skyline_delta(index.skyline, after.skyline)
    assert {tuple(r) for r in maintain.apply_skyline_delta(index.skyline, delta).collect()} == {tuple(r) for r in after.skyline.collect()}


def test_bridge_deletion_and_frontier_growth(spark):
    triangle = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)]
    index = CoreIndex.build(build(spark, "directed", [*triangle, (3, 4)]))
    after = maintain.apply_updates(index, None, spark.createDataFrame([(3, 4)], "src long, dst long"))
    assert maintain.skyline_delta(index.skyline, after.skyline).count() == 0
    sizes = lambda i: sorted(len(list(x)) for _, x in itertools.groupby(sorted(r.component for r in i.components((1, 1)).collect())))
    assert sizes(index) == [6] and sizes(after) == [3, 3]
    grown = maintain.apply_updates(index, spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "src long, dst long"))
    assert {r.v for r in grown.members((2, 2)).collect()} == {1, 2, 3} and index.members((2, 2)).count() == 0
    one, two = maintain.what_if(index, [(None, spark.createDataFrame([(1, 2)], "src long, dst long")), (None, None)])
    assert two.skyline.exceptAll(index.skyline).isEmpty() and not one.skyline.exceptAll(index.skyline).isEmpty()


def test_hand_made_cases(spark):
    g = build(spark, "bipartite", [(1, 10), (1, 11), (2, 10), (2, 11), (1, 12)])
    members = lambda t: {name("bipartite", r.v) for r in core_members(g, t).collect()}
    assert members((2, 2)) == {("U", 1), ("U", 2), ("V", 10), ("V", 11)}
    assert members((3, 1)) == {("U", 1), ("V", 10), ("V", 11), ("V", 12)}
    m = build(spark, "multilayer", [(k, a, b) for k in (0, 1) for a, b in ((1, 2), (2, 3), (1, 3))])
    assert core_members(m, (2, 2, 0)).count() == 3 and core_members(m, (2, 2, 1)).count() == 0


def test_thresholds_are_checked(spark):
    g = build(spark, "directed", [(1, 2)])
    for bad in [(1,), (1, 2, 3), (1.5, 2), ("1", 2), (True, 1)]:
        with pytest.raises(ValueError):
            core_members(g, bad)
    assert core_members(g, (-3, 0)).count() == 2
    with pytest.raises(ValueError):
        graphs.validate(spark.createDataFrame([(1, None)], "src long, dst long"), "src", "dst")


def test_empty_graph(spark):
    for kind in KINDS:
        index = CoreIndex.build(build(spark, kind, []))
        assert index.skyline.count() == 0 and index.components((1,) * index.graph.dims).count() == 0 and index.stats().first()["cores"] == 0


def test_save_and_load(spark, tmp_path):
    edges, extra = naive.random_graph("directed", 4, n=15, m=60)
    index = CoreIndex.build(build(spark, "directed", edges, extra), forest=True)
    index.save(f"file://{tmp_path}/i")
    again = CoreIndex.load(spark, f"file://{tmp_path}/i")
    assert sorted(index.skyline.collect()) == sorted(again.skyline.collect())
    assert sorted(index.components((1, 1)).collect()) == sorted(again.components((1, 1)).collect())
    plan = again.explain((2, 1))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(c0,2)" in plan


def test_edges_and_counts(spark):
    g = build(spark, "bipartite", [(1, 10), (1, 10), (2, 10)])
    assert g.edges.count() == 2 and {tuple(r) for r in g.max_degrees().collect()} == {(0, 1), (1, 2)}
    assert g.has_edges(spark.createDataFrame([(1, 10), (9, 9)], "u long, v long")).count() == 1
    assert g.without_edges(spark.createDataFrame([(1, 10)], "u long, v long")).edges.count() == 1
    m = build(spark, "multilayer", [(0, 1, 2), (2, 2, 1), (2, 2, 3)])
    assert {tuple(r) for r in graphs.edge_counts(m).collect()} == {(0, 1), (2, 2), (None, 3)}


def test_workload(spark):
    edges, extra = naive.random_graph("directed", 6, n=12, m=50)
    index = CoreIndex.build(build(spark, "directed", edges, extra))
    vectors = decompose.threshold_vectors(decompose.frontier(index.skyline, index.graph), index.graph)
    once = sorted(workload.random_thresholds(vectors, index.graph, 50, 3).collect())
    assert once == sorted(workload.random_thresholds(vectors, index.graph, 50, 3).collect()) and len(once) == 50
    sizes = {r.c1: r["size"] for r in index.batch_sizes(workload.sweep(spark, (1, None), [0, 1, 99])).collect()}
    assert sizes[99] == 0 and sizes[0] >= sizes[1]
    assert workload.timed("x", lambda: index.members((1, 1)))["rows"] == index.members((1, 1)).count()
    links = induced_links(index.graph, index.members((1, 1)))
    assert connected_components(links, index.members((1, 1))).count() == index.members((1, 1)).count()
