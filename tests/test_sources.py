import pytest

from corelens.functions import boxes
from corelens.operators import decompose
from corelens.operators.components import connected_components
from corelens.operators.graphs import RIGHT
from corelens.operators.peel import core_members, induced_links
from corelens.plans import blocks
from corelens.plans.index import CoreIndex
from corelens.sources import readers, writers
from corelens.streaming.replay import replay, version_path



def _put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_directed(spark, tmp_path):
    g = readers.read_directed(spark, _put(tmp_path, "g", "4\n0 1 2\n1 2\n2 0 2\n3\n"))
    assert {tuple(r) for r in g.edges.collect()} == {(0, 1), (0, 2), (1, 2), (2, 0)}
    assert {r.v for r in g.vertices().collect()} == {0, 1, 2, 3}
    d = readers.read_degrees(spark, _put(tmp_path, "d", "0 1 2\n1 1 1\n"))
    assert {tuple(r) for r in d.collect()} == {(0, 1, 2), (1, 1, 1)}


def test_bipartite(spark, tmp_path):
    g = readers.read_bipartite(spark, _put(tmp_path, "b.e", "0 5\n0 6\n1 5\n"))
    assert g.edges.count() == 3
    assert readers.read_bipartite_counts(spark, _put(tmp_path, "b.meta", "2\n7\n")) == (2, 7)
    with pytest.raises(Exception, match="(?i)malformed|number"):
        readers.read_bipartite(spark, _put(tmp_path, "bad.e", "0 5\nx y\n")).edges.collect()
    s = readers.read_bipartite_skyline(spark, _put(tmp_path, "s", "2\n2 1 2 0 1 1 5\n1 2 0 2 5 6\n"))
    assert {tuple(r) for r in s.collect()} == {(2, 1, 0), (2, 1, 1), (2, 1, RIGHT + 5), (1, 2, RIGHT + 5), (1, 2, RIGHT + 6)}
    assert {tuple(r) for r in readers.read_frontier(spark, _put(tmp_path, "f", "1 4\n2 3\n"), plus_one=True).collect()} == {(1, 3), (2, 2)}


def test_multilayer(spark, tmp_path):
    g = readers.read_multilayer(spark, _put(tmp_path, "m", "2 3 3\n1 1 2\n1 2 2\n7 2 3\n7 3 2\n"))
    assert g.layers == (1, 7) and {tuple(r) for r in g.edges.collect()} == {(0, 1, 2), (1, 2, 3)}
    assert readers.read_multilayer(spark, _put(tmp_path, "m", "2 3 3\n1 1 2\n7 2 3\n"), (7, 1)).layers == (7, 1)
    s = readers.read_skyline(spark, _put(tmp_path, "s", "1\n1 0 2 2 8 9\n"), 3)
    assert {tuple(r) for r in s.collect()} == {(1, 0, 2, 8), (1, 0, 2, 9)}
    f = readers.read_multilayer_frontier(spark, _put(tmp_path, "f", "2\n0 1 4\n1 1 3\n"))
    assert {(tuple(r.prefix), r.max_last, r.free) for r in f.collect()} == {((0, 1), 4, 2), ((1, 1), 3, 2)}


def test_update_batches(spark, tmp_path):
    text = "A: 1 2 3 4\n7:(2,1)(1,2)|(1,1)\n8:|(0,1)\nD: 5 6\n9:(1,0)|\n\n10:(9,9)|\n"
    edges, deltas = readers.read_updates(spark, _put(tmp_path, "u", text))
    assert {(r.batch, r.op, tuple(r.ends)) for r in edges.collect()} == {(0, "A", (1, 2)), (0, "A", (3, 4)), (1, "D", (5, 6))}
    assert {(r.batch, r.vertex, tuple(r.coordinate), r.state) for r in deltas.collect()} == {
        (0, 7, (2, 1), "new"), (0, 7, (1, 2), "new"), (0, 7, (1, 1), "old"), (0, 8, (0, 1), "old"), (1, 9, (1, 0), "new")
    }
    three, _ = readers.read_updates(spark, _put(tmp_path, "u3", "A: 1 2 0 3 4 1\n"), 3)
    assert {tuple(r.ends) for r in three.collect()} == {(1, 2, 0), (3, 4, 1)}


def test_published_fixture(spark, tmp_path):
    """The expected skyline as a file: frontier, dominance and nesting follow from it."""
    text = "8\n4 4 5 0 1 2 3 4\n3 3 4 5 6 7 8\n2 2 2 9 10\n0 2 1 11\n1 1 5 11 13 14 15 16\n4 1 1 12\n2 0 1 14\n3 1 1 17\n"
    points = readers.read_skyline(spark, _put(tmp_path, "s", text))
    assert points.count() == 20
    sizes = {(0, 0): 18, (1, 1): 18, (0, 2): 12, (2, 0): 14, (2, 2): 11, (3, 1): 11, (3, 3): 9, (4, 1): 6, (4, 4): 5, (5, 0): 0}
    for (k, l), n in sizes.items():
        assert points.where(f"c0 >= {k} and c1 >= {l}").select("v").distinct().count() == n
    assert decompose.maximal(points, ["c0", "c1"]).count() == 20


def test_boxes_and_blocks(spark):
    rows = [(a, b, 100 * a + b) for a in range(1, 8) for b in range(1, 8) if a + b <= 9]
    sky = spark.createDataFrame(rows, "c0 int, c1 int, v long")
    points = blocks.core_points(sky, ["c0", "c1"])
    tree = blocks.blocks(points, ["c0", "c1"], 4)
    query = boxes.query_box(2, 3, 2, 3)
    want = {(a, b) for a, b, _ in rows if 2 <= a <= 4 and 3 <= b <= 6}
    enclosed, rest = blocks.pruned(points, tree, query, ["c0", "c1"], 4)
    ids = {(r.first_core, r.last_core) for r in enclosed.collect()}
    got = {(r.c0, r.c1) for r in points.collect() if any(a <= r.core_id <= b for a, b in ids)} | {(r.c0, r.c1) for r in rest.collect()}
    assert got == want
    for kind in ("overlapping", "enclosing"):
        assert blocks.accepted(points, query, ["c0", "c1"], kind).count() == len(want)
    assert blocks.accepted(points, None, ["c0", "c1"], "any").count() == len(rows)
    assert blocks.removed(points, ["c0", "c1"], query).count() == len(rows) - len(want)
    assert blocks.removed(points, ["c0", "c1"]).count() == 0
    assert blocks.removed(points, ["c0", "c1"], cores=points.where("core_id < 3")).count() == len(rows) - 3
    size = blocks.index_bytes(tree, 2).first()
    assert size["height"] == 3 and size["nodes"] == tree.count()
    root = tree.where("parent is null").first()
    assert (root.lo0, root.hi0, root.lo1, root.hi1) == (1, 7, 1, 7)
    one = spark.range(1)
    a, b = boxes.query_box(0, 0, 4, 4), boxes.query_box(2, 1, 4, 1)
    value = lambda c: one.select(c.alias("x")).first()[0]
    assert value(boxes.overlap_area(a, b)) == 2 and value(boxes.area(b)) == 4 and value(boxes.margin(b)) == 5
    assert value(boxes.overlaps(a, b)) and not value(boxes.encloses(a, b)) and value(boxes.encloses(a, boxes.point_box((4, 0))))
    assert value(boxes.centre_distance(a, b)) == 4.25 and value(boxes.equal(a, a)) and value(boxes.text(b)) == "[2..6][1..2]"
    for bad in (lambda: boxes.box((1,), ()), lambda: boxes.ordering("x", 2), lambda: boxes.acceptor("enclosing", None, 2), lambda: boxes.acceptor("x", a, 2)):
        with pytest.raises(ValueError):
            bad()


def test_replay(spark, tmp_path):
    from corelens.operators import graphs

    base = graphs.directed(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"))
    CoreIndex.build(base).save(version_path(f"file://{tmp_path}/index", 0))
    incoming = tmp_path / "in"
    incoming.mkdir()
    schema = "op string, src long, dst long"
    for k, rows in enumerate([[("A", 4, 1), ("A", 4, 5)], [("D", 3, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{incoming}")
        changes = spark.readStream.schema(schema).json(f"file://{incoming}")
        replay(changes, f"file://{tmp_path}/index", f"file://{tmp_path}/state").awaitTermination()
        now = CoreIndex.load(spark, version_path(f"file://{tmp_path}/index", k + 1))
        edges = {(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (4, 5)} - ({(3, 4)} if k else set())
        assert {tuple(r) for r in now.graph.edges.collect()} == edges
        fresh = graphs.directed(spark.createDataFrame(sorted(edges), "src long, dst long"))
        members = core_members(fresh, (1, 1))
        assert {r.v for r in now.members((1, 1)).collect()} == {r.v for r in members.collect()}
        want = {tuple(r) for r in connected_components(induced_links(fresh, members), members).collect()}
        assert {tuple(r) for r in now.components((1, 1)).collect()} == want


def test_series(spark, tmp_path):
    writers.write_series(spark, f"file://{tmp_path}/t", [{"name": "a", "seconds": 1.5}])
    writers.write_series(spark, f"file://{tmp_path}/t", [{"name": "b", "seconds": 2.5}])
    assert spark.read.json(f"file://{tmp_path}/t").count() == 2
    writers.write_table(spark.range(3), f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 3
