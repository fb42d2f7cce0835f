"""Graphs beyond the broadcast limit: each task reads the edges itself."""

import naive
import pytest
from test_cores import KINDS, build

from corelens.operators import decompose


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("seed", [1, 4])
def test_tasks_equal_arrays(spark, kind, seed, monkeypatch):
    edges, extra = naive.random_graph(kind, seed, n=14, m=60)
    g = build(spark, kind, edges, extra)
    want = {tuple(r) for r in decompose.row_values(g, None, "arrays").collect()}
    points = {tuple(r) for r in decompose.skyline(g).collect()}
    some = sorted({r[: g.dims - 1] for r in want})[::2]
    assert {tuple(r) for r in decompose.row_values(g, None, "tasks").collect()} == want
    assert {tuple(r) for r in decompose.row_values(g, some, "tasks").collect()} == {r for r in want if r[: g.dims - 1] in set(some)}
    monkeypatch.setattr(decompose, "ARRAY_EDGES", 0)
    monkeypatch.setattr(decompose, "_by_rounds", None)  # never prefix by prefix
    assert {tuple(r) for r in decompose.row_values(g).collect()} == want
    assert {tuple(r) for r in decompose.skyline(g).collect()} == points


def test_slices_of_a_peel(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from corelens.operators import peel

    edges, _ = naive.random_graph("directed", 7, n=40, m=300)
    a, b = (np.array(x, np.int64) for x in zip(*sorted({e for e in edges if e[0] != e[1]}), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b)], names=["dim", "a", "b"])
    found = peel.CompactArrays("directed", 2, iter([batch]))
    want = [found.last_values(found.start(), (k,), 0).tolist() for k in range(1)]
    monkeypatch.setattr(peel, "ARCS_AT_ONCE", 3)
    assert [found.last_values(found.start(), (k,), 0).tolist() for k in range(1)] == want
    assert want[0] == peel.arrays_from("directed", 2, np.zeros(len(a), np.int64), a, b).last_values((0,), 0).tolist()


def test_far_ids(spark):
    edges, extra = naive.random_graph("directed", 7, n=14, m=60)
    g = build(spark, "directed", [(a << 33, b << 33) for a, b in edges], [v << 33 for v in extra])
    rows = lambda engine: {tuple(r) for r in decompose.row_values(g, None, engine).collect()}
    assert rows("tasks") == rows("arrays")
