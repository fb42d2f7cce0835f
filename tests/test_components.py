import random

import pytest

from corelens.operators.components import DisjointSets, connected_components, linked_components


def _naive(edges, vertices):
    sets = DisjointSets()
    for v in vertices:
        sets.find(v)
    for a, b in edges:
        sets.union(a, b)
    return {v: sets.find(v) for v in sets.parent}


@pytest.mark.parametrize("engine", ["rounds", "one_task"])
@pytest.mark.parametrize("seed,n,m", [(1, 40, 25), (2, 200, 150), (3, 60, 300)])
def test_random_graphs(spark, engine, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in connected_components(df, engine=engine).collect()}
    assert got == _naive(edges, {x for e in edges for x in e})


def test_long_path_and_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in connected_components(df, engine="rounds").collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 601


@pytest.mark.parametrize("engine", ["auto", "rounds"])
def test_isolated_null_and_empty(spark, engine):
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none, engine=engine).collect() == []
    some = spark.createDataFrame([(5, 5), (None, 7), (1, 2), (1, 2)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(some, spark.createDataFrame([(9,), (None,), (1,), (2,)], "v long"), engine=engine).collect()}
    assert got == {9: 9, 1: 1, 2: 1}


def test_unknown_engine(spark):
    with pytest.raises(ValueError):
        connected_components(spark.createDataFrame([], "a long, b long"), engine="x")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_linked(spark, limit):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(None, 3)]
    df = spark.createDataFrame(edges, "x long, y long").repartition(4)
    want = {v: c for v, c in _naive(edges[:-1], {x for e in edges[:-1] for x in e}).items() if v != c}
    assert {r.vertex: r.component for r in linked_components(df, "x", "y", limit).collect()} == want
