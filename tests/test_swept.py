import naive
from test_cores import KINDS, build

from corelens.operators import decompose


def test_batch_components_of_a_large_graph(spark, monkeypatch):
    from corelens.plans import index as plans

    for kind in KINDS:
        edges, extra = naive.random_graph(kind, 2, n=12, m=40)
        g = build(spark, kind, edges, extra)
        index = plans.CoreIndex.build(g, fanout=3)
        rows = [tuple(r) for r in decompose.threshold_vectors(decompose.frontier(index.skyline, g), g).collect()]
        queries = spark.createDataFrame([(k, *t) for k, t in enumerate([*rows, (50,) * g.dims, (0,) * g.dims])], ", ".join(["qid long", *(f"{c} int" for c in g.coordinates)]))
        want = {tuple(r) for r in index.batch_components(queries).select("qid", "v", "component").collect()}
        with monkeypatch.context() as m:
            m.setattr(plans, "ONE_TASK_EDGES", 0)
            m.setattr(plans.CoreIndex, "components", None)  # never query by query
            assert {tuple(r) for r in index.batch_components(queries).collect()} == want
