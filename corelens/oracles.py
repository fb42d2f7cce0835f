"""SQL for the queries of the core-search engine.

Cores are peeled by recursion with a round counter; the last round is tested again, because a set that is removed whole in one round leaves a
set that isn't a core behind. Vertices are (side, id) pairs for bipartite graphs.
"""

from __future__ import annotations

BIP = "SELECT DISTINCT o_custkey AS u, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL"

_PAIRS = """SELECT o_custkey AS u, l_suppkey AS v, c_nationkey AS cn, s_nationkey AS sn, n1.n_regionkey AS cr, n2.n_regionkey AS sr, l_linestatus, l_returnflag
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey"""
LOC = f"SELECT DISTINCT u, v FROM ({_PAIRS}) WHERE cn = sn"
ADDS = f"SELECT DISTINCT u, v FROM ({_PAIRS}) WHERE cn <> sn AND cr = sr AND l_linestatus = 'O' AND l_returnflag = 'R'"
DELETES = f"SELECT DISTINCT u, v FROM ({_PAIRS}) WHERE cn = sn AND l_linestatus = 'F' AND l_returnflag = 'A'"

_STEPS = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, a.l_returnflag AS layer FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""
DIR = f"SELECT DISTINCT src, dst FROM ({_STEPS}) WHERE src <> dst"
ML = f"SELECT DISTINCT layer, least(src, dst) AS a, greatest(src, dst) AS b FROM ({_STEPS}) WHERE src <> dst"


def bip_core(edges: str, a: int, b: int) -> str:
    """CTEs e(u, v), core(u, v) and members(v_side, v)."""
    return f"""WITH RECURSIVE e AS ({edges}),
r(u, v, it) AS (SELECT u, v, 0 FROM e UNION ALL
  SELECT u, v, it + 1 FROM (SELECT *, bool_or(du < {a} OR dv < {b}) OVER () AS bad FROM
    (SELECT u, v, it, count(*) OVER (PARTITION BY u) AS du, count(*) OVER (PARTITION BY v) AS dv FROM r)) WHERE bad AND du >= {a} AND dv >= {b}),
l AS (SELECT u, v, count(*) OVER (PARTITION BY u) AS du, count(*) OVER (PARTITION BY v) AS dv FROM r WHERE it = (SELECT max(it) FROM r)),
core AS (SELECT u, v FROM l WHERE NOT (SELECT bool_or(du < {a} OR dv < {b}) FROM l)),
members AS (SELECT DISTINCT 'U' AS v_side, u AS v FROM core UNION SELECT DISTINCT 'V', v FROM core)"""


#: From core(u, v): labels(v_side, v, component_side, component), the smallest vertex that each reaches, U before V.
_BIP_LABELS = """
ends AS (SELECT 'U' AS xs, u AS x, 'V' AS ys, v AS y FROM core UNION SELECT 'V', v, 'U', u FROM core),
reach(xs, x, ys, y) AS (SELECT xs, x, xs, x FROM ends UNION SELECT r.xs, r.x, e.ys, e.y FROM reach r JOIN ends e ON e.xs = r.ys AND e.x = r.y),
labels AS (SELECT xs AS v_side, x AS v, min(struct_pack(s := ys, i := y)) AS m FROM reach GROUP BY ALL),
named AS (SELECT v_side, v, m.s AS component_side, m.i AS component FROM labels)"""


def bip_grid(edges: str) -> str:
    """CTEs e(u, v), cores(c0, c1, u, v) of every threshold pair, inside(c0, c1, v_side, v) and sky(c0, c1, v_side, v)."""
    return f"""WITH RECURSIVE e AS ({edges}),
g AS (SELECT a, b FROM (SELECT unnest(generate_series(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY u)))) AS a),
  (SELECT unnest(generate_series(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY v)))) AS b)),
r(a, b, u, v, it) AS (SELECT a, b, u, v, 0 FROM e, g UNION ALL
  SELECT a, b, u, v, it + 1 FROM (SELECT *, bool_or(du < a OR dv < b) OVER (PARTITION BY a, b) AS bad FROM
    (SELECT a, b, u, v, it, count(*) OVER (PARTITION BY a, b, u) AS du, count(*) OVER (PARTITION BY a, b, v) AS dv FROM r)) WHERE bad AND du >= a AND dv >= b),
top AS (SELECT a, b, max(it) AS it FROM r GROUP BY a, b),
l AS (SELECT a, b, u, v, count(*) OVER (PARTITION BY a, b, u) AS du, count(*) OVER (PARTITION BY a, b, v) AS dv FROM r JOIN top USING (a, b, it)),
cores AS (SELECT a::INT AS c0, b::INT AS c1, u, v FROM (SELECT *, bool_or(du < a OR dv < b) OVER (PARTITION BY a, b) AS bad FROM l) WHERE NOT bad),
inside AS (SELECT DISTINCT c0, c1, 'U' AS v_side, u AS v FROM cores UNION SELECT DISTINCT c0, c1, 'V', v FROM cores),
sky AS (SELECT * FROM inside i WHERE NOT EXISTS (SELECT 1 FROM inside j WHERE j.v_side = i.v_side AND j.v = i.v AND j.c0 >= i.c0 AND j.c1 >= i.c1 AND (j.c0 > i.c0 OR j.c1 > i.c1))),
points AS (SELECT c0, c1, count(*) AS members, row_number() OVER (ORDER BY c0, c1) - 1 AS core_id FROM sky GROUP BY c0, c1)"""


#: From cores: labels by threshold pair.
_GRID_LABELS = """
ends AS (SELECT c0, c1, 'U' AS xs, u AS x, 'V' AS ys, v AS y FROM picked UNION SELECT c0, c1, 'V', v, 'U', u FROM picked),
reach(c0, c1, xs, x, ys, y) AS (SELECT c0, c1, xs, x, xs, x FROM ends UNION
  SELECT r.c0, r.c1, r.xs, r.x, e.ys, e.y FROM reach r JOIN ends e ON e.c0 = r.c0 AND e.c1 = r.c1 AND e.xs = r.ys AND e.x = r.y),
labels AS (SELECT c0, c1, xs AS v_side, x AS v, min(struct_pack(s := ys, i := y)) AS m FROM reach GROUP BY ALL),
named AS (SELECT c0, c1, v_side, v, m.s AS component_side, m.i AS component FROM labels)"""


def vertex_core(vertices: str, needs: list[tuple[str, str, str, str, int]]) -> str:
    """CTE members(v) for vertex thresholds; needs: (CTE name, its SQL, column of the vertex, column of the neighbour, threshold)."""
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in {n[0]: n[1] for n in needs}.items())
    tests = " AND ".join(f"(SELECT count(*) FROM {name} JOIN r AS o ON o.v = {name}.{nbr} WHERE {name}.{own} = x.v) >= {t}" for name, _, own, nbr, t in needs)
    final = " AND ".join(f"(SELECT count(*) FROM {name} JOIN l AS o ON o.v = {name}.{nbr} WHERE {name}.{own} = x.v) >= {t}" for name, _, own, nbr, t in needs)
    return f"""WITH RECURSIVE {ctes}, verts AS ({vertices}),
r(v, it) AS (SELECT v, 0 FROM verts UNION ALL
  SELECT v, it + 1 FROM (SELECT v, it, ok, bool_and(ok) OVER () AS stable FROM (SELECT x.v, x.it, {tests} AS ok FROM r AS x)) WHERE ok AND NOT stable),
l AS (SELECT v FROM r WHERE it = (SELECT max(it) FROM r)),
members AS (SELECT v FROM l WHERE (SELECT bool_and({final}) FROM l AS x))"""


def _dir_core(k: int, l: int) -> str:
    return vertex_core(f"SELECT src AS v FROM ({DIR}) UNION SELECT dst FROM ({DIR})", [("e", DIR, "dst", "src", k), ("e", DIR, "src", "dst", l)])


def _ml_core(*t: int) -> str:
    both = lambda layer: f"SELECT a AS x, b AS y FROM ({ML}) WHERE layer = '{layer}' UNION SELECT b, a FROM ({ML}) WHERE layer = '{layer}'"
    return vertex_core(f"SELECT a AS v FROM ({ML}) UNION SELECT b FROM ({ML})", [(f"e{x}", both(x), "x", "y", n) for x, n in zip("ANR", t, strict=True)])


def _labelled(core: str, links: str) -> str:
    """(v, component) by propagating the smallest label; links: (x, y) both ways."""
    return f"""{core},
links AS (SELECT DISTINCT x, y FROM ({links}) WHERE x IN (SELECT v FROM members) AND y IN (SELECT v FROM members)),
reach(v, c) AS (SELECT v, v FROM members UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.v)
SELECT v, min(c) AS component FROM reach GROUP BY v"""


_DIR_LINKS = "SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e"
_ML_LINKS = "SELECT x, y FROM eA UNION SELECT x, y FROM eN UNION SELECT x, y FROM eR"

def _dir_grid(edges: str, all_edges: str = DIR) -> str:
    """All (k, l) of a directed graph: r peels the vertex sets of every pair at once; inside(c0, c1, v), sky(c0, c1, v). all_edges: whose ends are vertices."""
    return f"""WITH RECURSIVE e AS ({edges}), verts AS (SELECT src AS v FROM ({all_edges}) UNION SELECT dst FROM ({all_edges})),
deg AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY dst)) AS di, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY src)) AS dout),
g AS (SELECT a, b FROM (SELECT unnest(generate_series(0, least(di, 40))) AS a FROM deg), (SELECT unnest(generate_series(0, least(dout, 40))) AS b FROM deg)),
r(a, b, v, it) AS (SELECT a, b, v, 0 FROM g, verts UNION ALL
  SELECT a, b, v, it + 1 FROM (SELECT *, bool_or(NOT ok) OVER (PARTITION BY a, b) AS bad FROM (
    SELECT x.a, x.b, x.v, x.it, coalesce(i.n, 0) >= x.a AND coalesce(o.n, 0) >= x.b AS ok FROM r AS x
    LEFT JOIN (SELECT s.a, s.b, e.dst AS v, count(*) AS n FROM r AS s JOIN e ON e.src = s.v GROUP BY ALL) i ON i.a = x.a AND i.b = x.b AND i.v = x.v
    LEFT JOIN (SELECT s.a, s.b, e.src AS v, count(*) AS n FROM r AS s JOIN e ON e.dst = s.v GROUP BY ALL) o ON o.a = x.a AND o.b = x.b AND o.v = x.v)) WHERE bad AND ok),
top AS (SELECT a, b, max(it) AS it FROM r GROUP BY a, b),
l AS (SELECT a, b, v FROM r JOIN top USING (a, b, it)),
t AS (SELECT x.a, x.b, x.v, coalesce(i.n, 0) >= x.a AND coalesce(o.n, 0) >= x.b AS ok FROM l AS x
    LEFT JOIN (SELECT s.a, s.b, e.dst AS v, count(*) AS n FROM l AS s JOIN e ON e.src = s.v GROUP BY ALL) i ON i.a = x.a AND i.b = x.b AND i.v = x.v
    LEFT JOIN (SELECT s.a, s.b, e.src AS v, count(*) AS n FROM l AS s JOIN e ON e.dst = s.v GROUP BY ALL) o ON o.a = x.a AND o.b = x.b AND o.v = x.v),
inside AS (SELECT a::INT AS c0, b::INT AS c1, v FROM (SELECT *, bool_and(ok) OVER (PARTITION BY a, b) AS fine FROM t) WHERE fine),
best AS (SELECT v, c0, max(c1) AS c1 FROM inside GROUP BY v, c0),
sky AS (SELECT c0, c1, v FROM (SELECT *, max(c1) OVER (PARTITION BY v ORDER BY c0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM best) WHERE above IS NULL OR c1 > above)"""


_DIR_GRID = _dir_grid(DIR)

_TRADED = f"""SELECT layer, a, b, n * 100.0 * count(*) OVER (PARTITION BY layer) / sum(n) OVER (PARTITION BY layer) AS percent FROM
  (SELECT l_returnflag AS layer, least(cn, sn) AS a, greatest(cn, sn) AS b, count(*) AS n FROM ({_PAIRS}) WHERE cn <> sn GROUP BY ALL)"""


def _trade(condition: str) -> str:
    return f"SELECT layer, a, b FROM ({_TRADED}) WHERE {condition}"


def ml_grid(edges: str, all_edges: str) -> str:
    """All thresholds of three layers A, N, R: inside(c0, c1, c2, v) and sky(c0, c1, c2, v)."""
    degrees = lambda of: f"(SELECT s.c0, s.c1, s.c2, e.x AS v, count(*) FILTER (layer = 'A') AS n0, count(*) FILTER (layer = 'N') AS n1, count(*) FILTER (layer = 'R') AS n2 FROM {of} AS s JOIN e ON e.y = s.v GROUP BY ALL)"
    fine = "coalesce(n0, 0) >= x.c0 AND coalesce(n1, 0) >= x.c1 AND coalesce(n2, 0) >= x.c2 AS ok"
    top = lambda layer: f"(SELECT unnest(generate_series(0, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM e WHERE layer = '{layer}' GROUP BY x)), 0))) AS c{'ANR'.index(layer)})"
    return f"""WITH RECURSIVE e AS (SELECT layer, a AS x, b AS y FROM ({edges}) UNION SELECT layer, b, a FROM ({edges})),
verts AS (SELECT a AS v FROM ({all_edges}) UNION SELECT b FROM ({all_edges})),
g AS (SELECT * FROM {top("A")}, {top("N")}, {top("R")}),
r(c0, c1, c2, v, it) AS (SELECT c0, c1, c2, v, 0 FROM g, verts UNION ALL
  SELECT c0, c1, c2, v, it + 1 FROM (SELECT *, bool_or(NOT ok) OVER (PARTITION BY c0, c1, c2) AS bad FROM (
    SELECT x.c0, x.c1, x.c2, x.v, x.it, {fine} FROM r AS x LEFT JOIN {degrees("r")} n ON n.c0 = x.c0 AND n.c1 = x.c1 AND n.c2 = x.c2 AND n.v = x.v)) WHERE bad AND ok),
top AS (SELECT c0, c1, c2, max(it) AS it FROM r GROUP BY ALL),
l AS (SELECT c0, c1, c2, v FROM r JOIN top USING (c0, c1, c2, it)),
t AS (SELECT x.*, {fine} FROM l AS x LEFT JOIN {degrees("l")} n ON n.c0 = x.c0 AND n.c1 = x.c1 AND n.c2 = x.c2 AND n.v = x.v),
inside AS (SELECT c0::INT AS c0, c1::INT AS c1, c2::INT AS c2, v::BIGINT AS v FROM (SELECT *, bool_and(ok) OVER (PARTITION BY c0, c1, c2) AS fine FROM t) WHERE fine),
sky AS (SELECT * FROM inside i WHERE NOT EXISTS (SELECT 1 FROM inside j WHERE j.v = i.v AND j.c0 >= i.c0 AND j.c1 >= i.c1 AND j.c2 >= i.c2 AND (j.c0 > i.c0 OR j.c1 > i.c1 OR j.c2 > i.c2)))"""


_LEAF = "leaf AS (SELECT core_id // 8 AS block_id, min(c0) AS lo0, max(c0) AS hi0, min(c1) AS lo1, max(c1) AS hi1, min(core_id) AS first_core, max(core_id) AS last_core, count(*) AS items FROM points GROUP BY 1)"
_AFTER_ADDS = f"SELECT u, v FROM ({LOC}) UNION SELECT u, v FROM ({ADDS})"
_AFTER_DELETES = f"SELECT u, v FROM ({LOC}) EXCEPT SELECT u, v FROM ({DELETES})"
_AFTER_BOTH = f"SELECT u, v FROM ({_AFTER_ADDS}) EXCEPT SELECT u, v FROM ({DELETES})"
_SIZES = "SELECT qid, c0, c1, (SELECT count(*) FROM inside i WHERE i.c0 = q.c0 AND i.c1 = q.c1) AS size FROM q"
_SOME = "q AS (SELECT * FROM (VALUES (0::BIGINT, 1, 1), (1, 2, 5), (2, 3, 10), (3, 1, 20), (4, 4, 8)) t(qid, c0, c1))"

ORACLES = {
    "bip_edges": BIP,
    "bip_degree_profile": f"""WITH e AS ({BIP}) SELECT dim, degree, count(*) AS n FROM (SELECT 0 AS dim, count(*) AS degree FROM e GROUP BY u UNION ALL SELECT 1, count(*) FROM e GROUP BY v) GROUP BY ALL""",
    "bip_max_degrees": f"""WITH e AS ({BIP}) SELECT 0 AS dim, max(n) AS max_degree FROM (SELECT count(*) AS n FROM e GROUP BY u) UNION ALL SELECT 1, max(n) FROM (SELECT count(*) AS n FROM e GROUP BY v)""",
    "bip_is_edge": f"SELECT u, v FROM ({BIP}) WHERE u = v AND u IN (SELECT c_custkey FROM customer) AND v IN (SELECT p_partkey FROM part)",
    "bip_sizes": f"WITH e AS ({BIP}) SELECT count(DISTINCT u) AS n_0, count(DISTINCT v) AS n_1, count(DISTINCT u) + count(DISTINCT v) AS n_vertices, count(*) AS n_edges FROM e",
    "ml_nodes": f"SELECT a AS v FROM ({ML}) UNION SELECT b FROM ({ML})",
    "bip_text_source": LOC,
    "vertex_cores": bip_grid(LOC) + " SELECT v_side, v, string_agg(core_id::VARCHAR, ',' ORDER BY core_id) AS cores FROM sky JOIN points USING (c0, c1) GROUP BY v_side, v",
    "axis_maxima": bip_grid(LOC) + " SELECT max(c0) AS c0, max(c1) AS c1 FROM points",
    "sweep_order": bip_grid(LOC) + " SELECT c0, c1, row_number() OVER (ORDER BY c1 DESC, c0) AS place, c0 = 2 AND c1 = 5 AS is_2_5 FROM points",
    "stream_replay_skyline": bip_grid(_AFTER_BOTH) + " SELECT c0, c1, v_side, v FROM sky",
    "ml_edge_counts_rollup": f"SELECT layer, count(*) AS n_edges FROM ({ML}) GROUP BY ROLLUP (layer)",
    "dir_adjacency": f"""WITH e AS ({DIR}) SELECT 0 AS dim, dst AS v, string_agg(src::VARCHAR, ',' ORDER BY src) AS neighbours FROM e GROUP BY dst
      UNION ALL SELECT 1, src, string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM e GROUP BY src""",
    "ab_core_members": bip_core(BIP, 20, 15) + " SELECT v_side, v FROM members",
    "ab_core_members_rounds": bip_core(BIP, 20, 15) + " SELECT v_side, v FROM members",
    "ab_core_empty": bip_core(BIP, 30, 20) + " SELECT v_side, v FROM members",
    "ab_core_components": bip_core(LOC, 2, 5) + "," + _BIP_LABELS + " SELECT * FROM named",
    "ab_forest_components": bip_core(LOC, 2, 5) + "," + _BIP_LABELS + " SELECT * FROM named",
    "ab_component_sizes_topk": bip_core(LOC, 2, 5) + "," + _BIP_LABELS + " SELECT component_side, component, count(*) AS size FROM named GROUP BY ALL ORDER BY size DESC, component_side, component LIMIT 10",
    "merged_pieces": bip_core(LOC, 2, 5) + "," + _BIP_LABELS + " SELECT component_side, component, count(*) AS size FROM named GROUP BY ALL",
    "kl_core_members": _dir_core(8, 8) + " SELECT v FROM members",
    "kl_core_zero_l": _dir_core(8, 0) + " SELECT v FROM members",
    "kl_core_zero_k": _dir_core(0, 8) + " SELECT v FROM members",
    "kl_core_components": _labelled(_dir_core(8, 8), _DIR_LINKS),
    "ml_core_members": _ml_core(4, 4, 4) + " SELECT v FROM members",
    "ml_core_zero_layer": _ml_core(4, 4, 0) + " SELECT v FROM members",
    "ml_core_components": _labelled(_ml_core(4, 4, 4), _ML_LINKS),
    "ab_skyline": bip_grid(LOC) + " SELECT c0, c1, v_side, v FROM sky",
    "ab_frontier": bip_grid(LOC) + " SELECT c0, max(c1) AS max_last FROM inside GROUP BY c0",
    "ab_threshold_vectors": bip_grid(LOC) + " SELECT DISTINCT c0, c1 FROM inside",
    "ab_vertex_skyline_count": bip_grid(LOC) + " SELECT v_side, v, count(*) AS n FROM sky GROUP BY ALL",
    "kl_skyline": _DIR_GRID + " SELECT * FROM sky",
    "kl_frontier": _DIR_GRID + " SELECT c0, max(c1) AS max_last FROM inside GROUP BY c0",
    "skyline_membership_array": bip_grid(LOC) + " SELECT c0, c1, string_agg(v_side || v::VARCHAR, ',' ORDER BY v_side, v) AS members FROM sky GROUP BY c0, c1",
    "ab_search_from_skyline": bip_core(LOC, 2, 5) + " SELECT v_side, v FROM members",
    "ab_dominating_cores": bip_grid(LOC) + " SELECT * FROM points WHERE c0 >= 3 AND c1 >= 10",
    "ab_row_query": bip_grid(LOC) + " SELECT c0, c1, members FROM points WHERE c0 >= 2 AND c1 = 5",
    "ab_fixed_alpha_sweep": bip_grid(LOC) + ", q AS (SELECT i::BIGINT - 1 AS qid, 2 AS c0, i::INT AS c1 FROM (SELECT unnest(generate_series(1, 30)) AS i)) " + _SIZES,
    "ab_fixed_beta_sweep": bip_grid(LOC) + ", q AS (SELECT i::BIGINT - 1 AS qid, i::INT AS c0, 5 AS c1 FROM (SELECT unnest(generate_series(1, 8)) AS i)) " + _SIZES,
    "ab_batch_thresholds": bip_grid(LOC) + f", {_SOME} SELECT qid, v_side, v FROM inside JOIN q USING (c0, c1)",
    "ab_batch_components": bip_grid(LOC) + f", {_SOME}, picked AS (SELECT c0, c1, u, v FROM cores JOIN q USING (c0, c1)),{_GRID_LABELS} SELECT qid, v_side, v, component_side, component FROM named JOIN q USING (c0, c1)",
    "core_subgraphs": bip_grid(LOC) + f", picked AS (SELECT c0, c1, u, v FROM cores JOIN points USING (c0, c1)),{_GRID_LABELS} SELECT c0, c1, v_side, v, component_side, component FROM named JOIN sky USING (c0, c1, v_side, v)",
    "block_boxes": bip_grid(LOC)
    + f""", {_LEAF}, up AS (SELECT block_id // 8 AS block_id, min(lo0) AS lo0, max(hi0) AS hi0, min(lo1) AS lo1, max(hi1) AS hi1, min(first_core) AS first_core, max(last_core) AS last_core, count(*) AS items FROM leaf GROUP BY 1)
      SELECT 0 AS level, block_id, CASE WHEN (SELECT count(*) FROM leaf) > 1 THEN block_id // 8 END AS parent, lo0, hi0, lo1, hi1, first_core, last_core, items FROM leaf
      UNION ALL SELECT 1, block_id, NULL, lo0, hi0, lo1, hi1, first_core, last_core, items FROM up WHERE (SELECT count(*) FROM leaf) > 1""",
    "block_enclosed_vs_partial": bip_grid(LOC)
    + f""", {_LEAF} SELECT 'block' AS kind, block_id AS id, items AS n FROM leaf WHERE lo0 >= 2 AND lo1 >= 5
      UNION ALL SELECT 'point', core_id, members FROM points WHERE c0 >= 2 AND c1 >= 5 AND core_id // 8 NOT IN (SELECT block_id FROM leaf WHERE lo0 >= 2 AND lo1 >= 5)""",
    "box_measures": bip_grid(LOC)
    + f""", {_LEAF} SELECT block_id, ((hi0 - lo0) * (hi1 - lo1))::DOUBLE AS area, (hi0 - lo0 + hi1 - lo1)::DOUBLE AS margin,
      (greatest(0, least(hi0, 5) - greatest(lo0, 2)) * greatest(0, least(hi1, 17) - greatest(lo1, 5)))::DOUBLE AS overlap_area,
      pow((2 + 5 - lo0 - hi0) / 2.0, 2) + pow((5 + 17 - lo1 - hi1) / 2.0, 2) AS centre_distance,
      lo0 <= 5 AND hi0 >= 2 AND lo1 <= 17 AND hi1 >= 5 AS overlaps, lo0 >= 2 AND hi0 <= 5 AND lo1 >= 5 AND hi1 <= 17 AS enclosed, lo0 = 2 AND hi0 = 5 AND lo1 = 5 AND hi1 = 17 AS equal,
      '[' || lo0 || '..' || hi0 || '][' || lo1 || '..' || hi1 || ']' AS text FROM leaf""",
    "box_orderings": bip_grid(LOC)
    + f""", {_LEAF}, m AS (SELECT *, (hi0 - lo0) * (hi1 - lo1) AS area, greatest(0, least(hi0, 5) - greatest(lo0, 2)) * greatest(0, least(hi1, 17) - greatest(lo1, 5)) AS overlap,
      pow(7 - lo0 - hi0, 2) + pow(22 - lo1 - hi1, 2) AS distance FROM leaf)
      SELECT block_id, rank() OVER (ORDER BY lo0, hi0) AS by_first, rank() OVER (ORDER BY hi0, lo0) AS by_second, rank() OVER (ORDER BY area) AS by_area, rank() OVER (ORDER BY distance) AS by_distance, rank() OVER (ORDER BY overlap) AS by_overlap FROM m""",
    "box_count_visit": bip_grid(LOC) + " SELECT count(*) AS n FROM points WHERE c0 BETWEEN 1 AND 4 AND c1 BETWEEN 3 AND 13",
    "box_delete": bip_grid(LOC) + " SELECT c0, c1, members FROM points WHERE NOT (c0 BETWEEN 1 AND 4 AND c1 BETWEEN 3 AND 13)",
    "box_union": bip_grid(LOC) + f", {_LEAF} SELECT CASE WHEN (SELECT count(*) FROM leaf) > 1 THEN block_id // 8 END AS parent, min(lo0) AS lo0, max(hi0) AS hi0, min(lo1) AS lo1, max(hi1) AS hi1 FROM leaf GROUP BY 1",
    "index_stats": bip_grid(LOC)
    + f""", {_LEAF}, picked AS (SELECT c0, c1, u, v FROM cores JOIN points USING (c0, c1)),{_GRID_LABELS},
      n AS (SELECT count(*) AS leaves FROM leaf)
      SELECT (SELECT count(*) FROM points) AS cores, (SELECT sum(members) FROM points)::BIGINT AS memberships, (SELECT sum(8 + 4 * members) FROM points)::BIGINT AS core_bytes,
      (SELECT count(*) FROM (SELECT DISTINCT c0, c1, component_side, component FROM named JOIN sky USING (c0, c1, v_side, v))) AS subgraphs,
      ((SELECT sum(25 + 8 * items) FROM leaf) + CASE WHEN leaves > 1 THEN 25 + 4 * leaves ELSE 0 END)::BIGINT AS tree_bytes, (CASE WHEN leaves > 1 THEN 2 ELSE 1 END)::INT AS height, leaves + CASE WHEN leaves > 1 THEN 1 ELSE 0 END AS nodes FROM n""",
    "block_bitmap_sizes": bip_grid(LOC) + " SELECT core_id // 8 AS block_id, count(DISTINCT v_side || v::VARCHAR) AS distinct_members FROM sky JOIN points USING (c0, c1) GROUP BY 1",
    "ab_after_insert": bip_grid(_AFTER_ADDS) + " SELECT c0, c1, v_side, v FROM sky",
    "ab_after_delete": bip_grid(_AFTER_DELETES) + " SELECT c0, c1, v_side, v FROM sky",
    "ab_after_both": bip_core(_AFTER_BOTH, 2, 5) + "," + _BIP_LABELS + " SELECT * FROM named",
}


def _delta() -> str:
    old, new = bip_grid(LOC) + " SELECT c0, c1, v_side, v FROM sky", bip_grid(_AFTER_ADDS) + " SELECT c0, c1, v_side, v FROM sky"
    return f"SELECT *, 'new' AS state FROM (({new}) EXCEPT ({old})) UNION ALL SELECT *, 'old' FROM (({old}) EXCEPT ({new}))"


def _changes() -> str:
    old, new = bip_core(LOC, 2, 5) + " SELECT v_side, v FROM members", bip_core(_AFTER_BOTH, 2, 5) + " SELECT v_side, v FROM members"
    return f"SELECT *, 'enter' AS change FROM (({new}) EXCEPT ({old})) UNION ALL SELECT *, 'leave' FROM (({old}) EXCEPT ({new}))"


ORACLES["component_members_list"] = f"SELECT component, string_agg(v::VARCHAR, ',' ORDER BY v) AS members FROM ({_labelled(_dir_core(8, 8), _DIR_LINKS)}) GROUP BY component"
ORACLES |= {"ab_skyline_delta": _delta(), "ab_membership_changes": _changes()}


# Sources, maintenance of all models, seeded draws

_TRADE = _trade("percent > 115")
_ML_GRID = ml_grid(_TRADE, _TRADE)
_ML_AFTER_ADDS = f"SELECT * FROM ({_TRADE}) UNION SELECT * FROM ({_trade('percent > 110')})"
_ML_AFTER_DELETES = f"SELECT * FROM ({_TRADE}) EXCEPT SELECT * FROM ({_trade('percent > 125')})"
_JUMP = "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = {to} AND a.l_returnflag = '{flag}' AND a.l_partkey <> b.l_partkey"
_DIR_AFTER_ADDS = f"SELECT * FROM ({DIR}) UNION SELECT * FROM ({_JUMP.format(to=3, flag='R')})"
_DIR_AFTER_DELETES = f"SELECT * FROM ({DIR}) EXCEPT SELECT * FROM ({_JUMP.format(to=2, flag='A')})"


def _draws(columns: str) -> str:
    """CTEs q(qid, columns): 10,000 seeded draws from the distinct thresholds of inside."""
    return f""", valid AS (SELECT {columns}, row_number() OVER (ORDER BY {columns}) - 1 AS k FROM (SELECT DISTINCT {columns} FROM inside)),
x AS (SELECT i AS qid, (i + 1 + 7 * 7919) % 2147483647 * 48271 % 2147483647 AS x FROM (SELECT unnest(generate_series(0, 9999)) AS i)),
q AS (SELECT qid, {columns} FROM (SELECT qid, x * x % 2147483647 % (SELECT count(*) FROM valid) AS k FROM x) JOIN valid USING (k))"""


def _size_sweep() -> str:
    return f"""WITH RECURSIVE e AS ({LOC}),
ranked AS (SELECT u, v, row_number() OVER (ORDER BY x * x % 2147483647, u, v) AS k FROM (SELECT u, v, (u * 48271 + v * 16807) % 2147483647 * 48271 % 2147483647 AS x FROM e)),
s(size) AS (VALUES (0), (1), (4), (16), (64), (256), (1024)),
r(size, u, v, it) AS (SELECT size, u, v, 0 FROM ranked, s WHERE k > size UNION ALL
  SELECT size, u, v, it + 1 FROM (SELECT *, bool_or(du < 2 OR dv < 5) OVER (PARTITION BY size) AS bad FROM
    (SELECT size, u, v, it, count(*) OVER (PARTITION BY size, u) AS du, count(*) OVER (PARTITION BY size, v) AS dv FROM r)) WHERE bad AND du >= 2 AND dv >= 5),
top AS (SELECT size, max(it) AS it FROM r GROUP BY size),
l AS (SELECT size, u, v, count(*) OVER (PARTITION BY size, u) AS du, count(*) OVER (PARTITION BY size, v) AS dv FROM r JOIN top USING (size, it)),
core AS (SELECT size, u, v FROM (SELECT *, bool_or(du < 2 OR dv < 5) OVER (PARTITION BY size) AS bad FROM l) WHERE NOT bad),
inside AS (SELECT DISTINCT size, 'U' AS side, u AS v FROM core UNION SELECT DISTINCT size, 'V', v FROM core)
SELECT s.size, 'leave' AS change, count(*) AS n FROM s, inside o WHERE s.size > 0 AND o.size = 0 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.size = s.size AND i.side = o.side AND i.v = o.v) GROUP BY s.size"""


ORACLES |= {
    "dir_text_source": DIR,
    "dir_degrees_source": f"""WITH e AS ({DIR}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
      SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM v""",
    "ml_text_source": f"SELECT (CASE layer WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS dim, a, b FROM ({ML}) WHERE layer IN ('A', 'N', 'R')",
    "ab_skyline_source": ORACLES["ab_skyline"],
    "kl_skyline_source": ORACLES["kl_skyline"],
    "ml_skyline_source": _ML_GRID + " SELECT * FROM sky",
    "kl_frontier_source": ORACLES["kl_frontier"],
    "ab_frontier_source": ORACLES["ab_frontier"],
    "ml_frontier_source": _ML_GRID + " SELECT c0, c1, max(c2) AS max_last, 2 AS free FROM inside GROUP BY c0, c1",
    "bip_counts_source": f"WITH e AS ({LOC}) SELECT count(DISTINCT u) AS n_0, count(DISTINCT v) AS n_1 FROM e",
    "table_sink": ORACLES["ab_skyline"],
    "series_sink": bip_grid(LOC) + " SELECT c0, c1, count(*) AS size FROM inside WHERE (c0, c1) IN ((1, 1), (2, 5), (3, 10)) GROUP BY c0, c1",
    "update_file_source": f"SELECT 0::BIGINT AS batch, 'A' AS op, u, v FROM ({ADDS})",
    "ab_given_delta": ORACLES["ab_after_insert"],
    "ml_trade_skyline": _ML_GRID + " SELECT * FROM sky",
    "ml_threshold_vectors": _ML_GRID + " SELECT DISTINCT c0, c1, c2 FROM inside",
    "ml_random_thresholds": _ML_GRID + _draws("c0, c1, c2") + " SELECT qid, c0, c1, c2, n AS size FROM q JOIN (SELECT c0, c1, c2, count(*) AS n FROM inside GROUP BY ALL) USING (c0, c1, c2)",
    "random_thresholds_seeded": bip_grid(LOC) + _draws("c0, c1") + " SELECT qid, c0, c1, n AS size FROM q JOIN (SELECT c0, c1, count(*) AS n FROM inside GROUP BY ALL) USING (c0, c1)",
    "kl_fixed_k_sweep": _DIR_GRID + ", q AS (SELECT i AS qid, 5 AS c0, i::INT AS c1 FROM (SELECT unnest(generate_series(0, 11)) AS i)) " + _SIZES,
    "kl_fixed_l_sweep": _DIR_GRID + ", q AS (SELECT i AS qid, i::INT AS c0, 5 AS c1 FROM (SELECT unnest(generate_series(0, 11)) AS i)) " + _SIZES,
    "ab_blocks_after_both": bip_grid(_AFTER_BOTH) + f", {_LEAF} SELECT 0 AS level, block_id, lo0, hi0, lo1, hi1, first_core, last_core, items FROM leaf",
    "kl_after_insert": _dir_grid(_DIR_AFTER_ADDS, _DIR_AFTER_ADDS) + " SELECT * FROM sky",
    "kl_after_delete": _dir_grid(_DIR_AFTER_DELETES) + " SELECT * FROM sky",
    "ml_after_insert": ml_grid(_ML_AFTER_ADDS, _ML_AFTER_ADDS) + " SELECT * FROM sky",
    "ml_after_delete": ml_grid(_ML_AFTER_DELETES, _TRADE) + " SELECT * FROM sky",
    "block_tags": bip_grid(LOC)
    + f""", {_LEAF}, corner AS (SELECT block_id, lo0 AS c0, lo1 AS c1 FROM leaf), asked AS (SELECT c0, c1 FROM points UNION SELECT c0, c1 FROM corner),
      picked AS (SELECT c0, c1, u, v FROM cores JOIN asked USING (c0, c1)),{_GRID_LABELS}
      SELECT DISTINCT p.core_id // 8 AS block_id, p.core_id, n.component_side, n.component, t.component_side AS tag_side, t.component AS tag
      FROM named n JOIN sky s ON s.c0 = n.c0 AND s.c1 = n.c1 AND s.v_side = n.v_side AND s.v = n.v JOIN points p ON p.c0 = n.c0 AND p.c1 = n.c1
      JOIN corner k ON k.block_id = p.core_id // 8 JOIN named t ON t.c0 = k.c0 AND t.c1 = k.c1 AND t.v_side = n.v_side AND t.v = n.v""",
    "update_size_sweep": _size_sweep(),
    "ab_annotated_components": ORACLES["ab_forest_components"],
    "forest_subgraphs": ORACLES["core_subgraphs"],
    "connect_edge_counts": bip_grid(LOC)
    + f""", picked AS (SELECT c0, c1, u, v FROM cores),{_GRID_LABELS},
      own AS (SELECT * FROM sky JOIN named USING (c0, c1, v_side, v)),
      firsts AS (SELECT c0, c1, component_side, component, min(struct_pack(s := v_side, i := v)) AS f FROM own GROUP BY ALL),
      known AS (SELECT c0 - 1 AS c0, c1, 'U' AS xs, u AS x, 'V' AS ys, v AS y FROM cores UNION SELECT c0, c1 - 1, 'U', u, 'V', v FROM cores
        UNION SELECT c0, c1, f.s, f.i, v_side, v FROM own JOIN firsts USING (c0, c1, component_side, component)),
      ways AS (SELECT * FROM known UNION SELECT c0, c1, ys, y, xs, x FROM known),
      held(c0, c1, xs, x, ys, y) AS (SELECT c0, c1, v_side, v, v_side, v FROM inside UNION
        SELECT h.c0, h.c1, h.xs, h.x, k.ys, k.y FROM held h JOIN ways k ON k.c0 = h.c0 AND k.c1 = h.c1 AND k.xs = h.ys AND k.x = h.y),
      pieces AS (SELECT c0, c1, xs, x, min(struct_pack(s := ys, i := y)) AS m FROM held GROUP BY ALL),
      n AS (SELECT c0, c1, count(DISTINCT m) AS pieces FROM pieces GROUP BY ALL),
      k AS (SELECT c0, c1, count(DISTINCT struct_pack(s := component_side, i := component)) AS parts FROM named GROUP BY ALL)
      SELECT c0, c1, pieces - parts AS n FROM n JOIN k USING (c0, c1) WHERE pieces > parts""",
}
