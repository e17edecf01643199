"""Queries on the trade between nations: a small graph of whole tables with cycles, blocks and joins of every kind, on which
SQL finds the same sets by brute force (removing a node or an edge, growing every set, stepping through a stack)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.graph import GraphBuilder, Topology
from lodestone.operators import components, dag, matrix, mutable, paths, spanning, structure, traversal
from lodestone.operators.cache import TraversalCache
from lodestone.plans import graphs as T
from lodestone.plans.queries import ORACLES, _levels, _relaxed, _rows, query
from lodestone.plans.loop import number_rows
from lodestone.scratch import folder, materialize
from lodestone.sources import graph_json, legacy


def trade(spark: SparkSession, d: str, most: int) -> Topology:
    """Nations; from each an edge to the ``most`` other nations that its suppliers sell most to, w the whole quantity."""
    line = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    sold = line.join(T.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(T.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(T.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    pairs = sold.groupBy("src", "dst").agg(F.sum("q").cast("long").alias("w")).where("src <> dst")
    top = pairs.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("k") <= most)
    e = number_rows(top.select("src", "dst", "w"), ["src", "dst"], "edge").select("edge", "src", "dst", "w")
    return Topology(materialize(T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")), "vertices"), materialize(e, "edges"))


def _sql(most: int) -> str:
    return f"""tq AS MATERIALIZED (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, sum(l_quantity)::BIGINT AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM tq WHERE src <> dst) WHERE k <= {most}),
tn AS (SELECT n_nationkey::BIGINT AS node FROM nation),
ta AS MATERIALIZED (SELECT edge, src AS a, dst AS b, w FROM tr UNION ALL SELECT edge, dst, src, w FROM tr)"""


ONE, THREE = _sql(1), _sql(3)
_ROOT = "(SELECT min(src) FROM tr)"


def _root(t: Topology) -> int:
    return t.edges.agg(F.min("src")).first()[0]


# Control flow --------------------------------------------------------------------------------------------------------

_DOM = f"""WITH RECURSIVE {THREE}, x AS (SELECT node AS x FROM tn WHERE node <> {_ROOT} UNION ALL SELECT -1),
r AS (SELECT x, {_ROOT} AS node FROM x UNION SELECT r.x, tr.dst FROM r JOIN tr ON tr.src = r.node WHERE tr.dst <> r.x),
live AS MATERIALIZED (SELECT node FROM r WHERE x = -1),
dom AS MATERIALIZED (SELECT a.node AS d, b.node AS v FROM live a, live b WHERE a.node = b.node OR (a.node, b.node) NOT IN (SELECT x, node FROM r)),
depth AS (SELECT v, count(*) AS n FROM dom GROUP BY 1)"""


@query(_DOM + " SELECT l.node, (SELECT arg_max(d, n) FROM dom JOIN depth ON depth.v = d WHERE dom.v = l.node AND d <> l.node) AS idom FROM live l")
def dominators(spark, d):
    t = trade(spark, d, 3)
    return structure.dominators(t, _root(t))


@query(_DOM + " SELECT d AS dominator, v AS node FROM dom WHERE d <> v")
def strict_dominators(spark, d):
    t = trade(spark, d, 3)
    return structure.dominations(structure.dominators(t, _root(t)), strict=True)


@query(_DOM + f" SELECT DISTINCT dom.d AS node, p.dst AS frontier FROM dom JOIN tr p ON p.src = dom.v WHERE (SELECT count(*) FROM tr WHERE dst = p.dst AND src IN (SELECT node FROM live)) >= 2 AND (dom.d = p.dst OR (dom.d, p.dst) NOT IN (SELECT d, v FROM dom))")
def dominance_frontiers(spark, d):
    t = trade(spark, d, 3)
    return structure.dominance_frontiers(t, _root(t))


_LISTS = "tl AS MATERIALIZED (SELECT src AS node, list(dst ORDER BY edge) AS l, list(edge ORDER BY edge) AS e FROM tr GROUP BY 1)"


@query(f"""WITH RECURSIVE {THREE}, {_LISTS}, s AS (SELECT 0 AS step, NULL::BIGINT AS node, [{_ROOT}] AS stack, [{_ROOT}] AS marked UNION ALL
SELECT step + 1, stack[len(stack)], stack[1:len(stack) - 1] || list_reverse(fresh), marked || fresh FROM (SELECT s.*, list_filter(coalesce(l, []), lambda v: NOT list_contains(marked, v)) AS fresh FROM s LEFT JOIN tl ON tl.node = stack[len(stack)] WHERE len(stack) > 0))
SELECT step::BIGINT - 1 AS position, node FROM s WHERE step > 0""")
def dfs(spark, d):
    t = trade(spark, d, 3)
    return structure.dfs(t, _root(t))


@query(f"""WITH RECURSIVE {THREE}, {_LISTS}, s AS (
SELECT 0 AS seq, 'discover' AS event, {_ROOT} AS source, NULL::BIGINT AS target, NULL::BIGINT AS edge, [{_ROOT}] AS stack, [0] AS pos, [{_ROOT}] AS seen, []::BIGINT[] AS done, NULL::BIGINT AS nxt UNION ALL
SELECT seq + 1,
  CASE WHEN nxt IS NOT NULL THEN 'discover' WHEN v IS NULL THEN 'finish' WHEN NOT list_contains(seen, v) THEN 'tree_edge' WHEN list_contains(done, v) THEN 'cross_forward_edge' ELSE 'back_edge' END,
  CASE WHEN nxt IS NOT NULL THEN nxt ELSE u END, CASE WHEN nxt IS NULL THEN v END, CASE WHEN nxt IS NULL THEN x END,
  CASE WHEN nxt IS NOT NULL THEN list_append(stack, nxt) WHEN v IS NULL THEN stack[1:len(stack) - 1] ELSE stack END,
  CASE WHEN nxt IS NOT NULL THEN list_append(pos, 0) WHEN v IS NULL THEN pos[1:len(pos) - 1] ELSE list_append(pos[1:len(pos) - 1], pos[len(pos)] + 1) END,
  CASE WHEN nxt IS NOT NULL THEN list_append(seen, nxt) ELSE seen END, CASE WHEN nxt IS NULL AND v IS NULL THEN list_append(done, u) ELSE done END,
  CASE WHEN nxt IS NULL AND v IS NOT NULL AND NOT list_contains(seen, v) THEN v END
FROM (SELECT s.*, stack[len(stack)] AS u, l[pos[len(pos)] + 1] AS v, e[pos[len(pos)] + 1] AS x FROM s LEFT JOIN tl ON tl.node = stack[len(stack)] WHERE len(stack) > 0))
SELECT seq::BIGINT AS seq, event, source, target, edge FROM s""")
def dfs_events(spark, d):
    t = trade(spark, d, 3)
    return structure.depth_first_search(t, [_root(t)])


# Components and connectivity -----------------------------------------------------------------------------------------

_SCC = f"""WITH RECURSIVE {THREE}, r AS (SELECT node AS s, node AS t FROM tn UNION SELECT r.s, tr.dst FROM r JOIN tr ON tr.src = r.t),
c AS MATERIALIZED (SELECT x.s AS node, min(x.t) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY 1)"""


@query(_SCC + " SELECT DISTINCT a.component AS src, b.component AS dst FROM tr JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.component <> b.component")
def condensation(spark, d):
    return components.condensation(trade(spark, d, 3))[1].edges.select("src", "dst")


@query(_SCC + " SELECT node, component FROM c")
def condensation_members(spark, d):
    return components.condensation(trade(spark, d, 3))[0]


@query(_SCC + " SELECT edge, (SELECT count(*) FROM c a JOIN c b USING (component) WHERE a.node = src AND b.node = dst) > 0 AS inside FROM tr")
def feedback_candidates(spark, d):
    """Which edges lie on a cycle: those inside a strong component; what a feedback arc set removes is among them."""
    t = trade(spark, d, 3)
    c = components.condensation(t)[0]
    gone = structure.feedback_arc_set(t)
    left = t.edges.join(gone, "edge", "left_anti")
    if dag.has_cycle(Topology(t.vertices, left)) or gone.count() * 2 > t.edge_count():
        raise AssertionError("not a feedback arc set")
    e = t.edges.join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    e = e.join(gone.withColumn("gone", F.lit(True)), "edge", "left")
    return e.select("edge", ((F.col("a") == F.col("b")) | F.coalesce("gone", F.lit(False))).alias("inside"))


_BRIDGE = f"""WITH RECURSIVE {ONE}, r AS (SELECT edge AS x, src AS node FROM tr UNION SELECT r.x, ta.b FROM r JOIN ta ON ta.a = r.node WHERE ta.edge <> r.x),
bridge AS (SELECT edge FROM tr WHERE (edge, dst) NOT IN (SELECT x, node FROM r))"""


@query(_BRIDGE + " SELECT edge FROM bridge")
def bridges(spark, d):
    return structure.bridges(trade(spark, d, 1).undirected())


@query(_BRIDGE + " SELECT edge FROM tr WHERE edge NOT IN (SELECT edge FROM bridge)")
def chain_decomposition(spark, d):
    """The edges in chains: all but bridges, each once."""
    return structure.chain_decomposition(trade(spark, d, 1).undirected()).select("edge")


_AVOID = f"""WITH RECURSIVE {ONE}, r AS (SELECT DISTINCT x.node AS x, ta.b AS s, ta.b AS t FROM tn x JOIN ta ON ta.a = x.node UNION SELECT r.x, r.s, ta.b FROM r JOIN ta ON ta.a = r.t WHERE ta.b <> r.x)"""


@query(_AVOID + " SELECT DISTINCT p.a AS node FROM ta p JOIN ta q ON q.a = p.a WHERE (p.a, p.b, q.b) NOT IN (SELECT x, s, t FROM r)")
def articulation_points(spark, d):
    return structure.articulation_points(trade(spark, d, 1).undirected())


@query(_AVOID + """, near AS MATERIALIZED (SELECT p.edge AS e, q.edge AS f FROM ta p JOIN ta q ON q.a = p.a JOIN r ON r.x = p.a AND r.s = p.b AND r.t = q.b),
z AS (SELECT edge AS e, edge AS f FROM tr UNION SELECT z.e, near.f FROM z JOIN near ON near.e = z.f) SELECT min(f) AS block, e AS edge FROM z GROUP BY e""")
def biconnected_components(spark, d):
    return structure.biconnected_components(trade(spark, d, 1).undirected())


def _cores(edges: str, rounds: int) -> str:
    out = [f"p AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM {edges} WHERE src <> dst UNION SELECT dst, src FROM {edges} WHERE src <> dst)", "c0 AS MATERIALIZED (SELECT a AS node, count(*) AS core FROM p GROUP BY 1)"]
    for k in range(1, rounds + 1):
        out.append(f"c{k} AS MATERIALIZED (SELECT a AS node, max(least(k, core)) AS core FROM (SELECT a, core, row_number() OVER (PARTITION BY a ORDER BY core DESC) AS k FROM p JOIN c{k - 1} ON node = b) GROUP BY 1)")
    return ",\n".join(out)


@query(f"WITH {THREE}, {_cores('tr', 30)} SELECT node, coalesce(core, 0) AS core FROM tn LEFT JOIN c30 USING (node)")
def k_core_trade(spark, d):
    return components.k_core(trade(spark, d, 3))


ORACLES["k_core"] = f"WITH {T.SUPPLY}, {_cores('se', 30)} SELECT node, core FROM c30"


@query(f"WITH RECURSIVE {THREE}, r AS (SELECT edge AS x, w AS u, src AS node FROM tr UNION SELECT r.x, r.u, ta.b FROM r JOIN ta ON ta.a = r.node AND (ta.w < r.u OR (ta.w = r.u AND ta.edge < r.x))) SELECT edge, w::DECIMAL(38, 0) AS weight FROM tr WHERE (edge, dst) NOT IN (SELECT x, node FROM r)")
def minimum_spanning_forest(spark, d):
    """An edge is in the forest if smaller ones don't join its ends."""
    return spanning.minimum_spanning_forest(trade(spark, d, 3).undirected(), "w").select("edge", F.col("weight").cast("decimal(38,0)").alias("weight"))


@query(f"""WITH RECURSIVE {THREE}, u AS MATERIALIZED (SELECT a, list(DISTINCT b) AS l FROM ta GROUP BY 1),
k AS (SELECT [node] AS c, coalesce(l, []) AS common FROM tn LEFT JOIN u ON u.a = node UNION ALL SELECT list_append(c, v), list_intersect(common, u.l) FROM (SELECT c, common, unnest(common) AS v FROM k) JOIN u ON u.a = v WHERE v > c[len(c)])
SELECT array_to_string(c, '>') AS clique FROM k WHERE len(common) = 0""")
def maximal_cliques(spark, d):
    return structure.maximal_cliques(trade(spark, d, 3).undirected()).select(F.array_join(F.transform("clique", lambda x: x.cast("string")), ">").alias("clique"))


@query(f"WITH RECURSIVE {ONE}, m AS (SELECT -1 AS k, 0::BIGINT AS used UNION SELECT k + 1, x FROM (SELECT k, used, unnest(CASE WHEN used & ((1::BIGINT << src) | (1::BIGINT << dst)) = 0 THEN [used, used | (1::BIGINT << src) | (1::BIGINT << dst)] ELSE [used] END) AS x FROM m JOIN tr ON tr.edge = k + 1)) SELECT (max(bit_count(used)) // 2)::BIGINT AS pairs, true AS valid FROM m")
def maximum_matching(spark, d):
    t = trade(spark, d, 1).undirected()
    m = materialize(structure.maximum_matching(t), "matching")
    ends = m.select(F.explode(F.array("left", "right")).alias("x"))
    real = m.join(t.edges.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right")).distinct(), ["left", "right"], "left_semi")
    return _rows(spark, [(m.count(), real.count() == m.count() and ends.distinct().count() == ends.count())], "pairs long, valid boolean")


@query(f"WITH RECURSIVE {THREE}, s AS (SELECT src, row_number() OVER (ORDER BY src) AS k, list(dst) AS l FROM tr GROUP BY 1), m AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used UNION SELECT k, x FROM (SELECT s.k, unnest([used] || [used | (1::BIGINT << v) FOR v IN l IF (used >> v) & 1 = 0]) AS x FROM m JOIN s ON s.k = m.k + 1)) SELECT max(bit_count(used))::BIGINT AS pairs, true AS valid FROM m")
def maximum_bipartite_matching(spark, d):
    """Nations that sell, with nations that buy, each once."""
    t = trade(spark, d, 3)
    e = t.edges.select("edge", "src", (F.col("dst") + 100).alias("dst"))
    m = materialize(structure.maximum_bipartite_matching(Topology(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), e, False)), "matching")
    real = m.join(e.select(F.col("src").alias("left"), F.col("dst").alias("right")), ["left", "right"], "left_semi")
    ok = real.count() == m.count() == m.select("left").distinct().count() == m.select("right").distinct().count()
    return _rows(spark, [(m.count(), ok)], "pairs long, valid boolean")


_ODD = f"""WITH RECURSIVE {ONE}, w AS (SELECT node AS s, node AS t, 0 AS h FROM tn UNION SELECT w.s, ta.b, 1 - w.h FROM w JOIN ta ON ta.a = w.t),
c AS (SELECT s AS node, min(t) AS component, max(CASE WHEN s = t AND h = 1 THEN 1 ELSE 0 END) AS odd, count(DISTINCT t) AS n FROM w GROUP BY 1)"""


@query(_ODD + " SELECT component, CASE WHEN max(n) = 1 THEN 1 WHEN max(odd) = 1 THEN 3 ELSE 2 END::BIGINT AS colours FROM c GROUP BY 1")
def dsatur_coloring(spark, d):
    """Colours a component: two, or three where it has an odd cycle (no component has more than one cycle)."""
    t = trade(spark, d, 1).undirected()
    c = materialize(structure.dsatur(t), "colours")
    clash = t.edges.join(c.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
    if not clash.isEmpty():
        raise AssertionError("neighbours of one colour")
    return components.weakly_connected(t).join(c, "node").groupBy("component").agg(F.countDistinct("colour").alias("colours"))


@query(f"WITH {ONE} SELECT node, true AS stable FROM tn")
def label_propagation(spark, d):
    """Whether no other community is commoner among a node's neighbours."""
    t = trade(spark, d, 1)
    c = materialize(structure.label_propagation(t), "communities")
    near = components.simple_pairs(t).join(c.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count("*").alias("n"))
    best = near.groupBy("node").agg(F.max("n").alias("most"))
    own = c.join(near, ["node", "community"], "left").join(best, "node", "left")
    return own.select("node", (F.coalesce("n", F.lit(0)) == F.coalesce("most", F.lit(0))).alias("stable"))


@query(f"WITH {THREE}, {_relaxed('SELECT a, b, min(w) AS w FROM ta GROUP BY 1, 2', 'SELECT node AS source, node FROM tn', 9)} SELECT x.node AS terminal, cost FROM tn x JOIN d ON d.node = x.node AND d.source = {_ROOT} WHERE x.node <> {_ROOT} AND x.node IN (SELECT dst FROM tr WHERE src = {_ROOT})")
def steiner_tree(spark, d):
    """Of two terminals the tree is a shortest path: the root and each nation that it sells to."""
    t = trade(spark, d, 3)
    root = _root(t)
    ends = [r[0] for r in t.edges.where(F.col("src") == root).select("dst").orderBy("dst").collect()]
    return _rows(spark, [(x, structure.steiner_tree(t.undirected(), [root, x], "w")[0]) for x in ends], "terminal long, cost long")


# Paths ---------------------------------------------------------------------------------------------------------------

_ARCS = "SELECT src AS a, dst AS b, w FROM tr"
_FROM_ROOT = f"SELECT {_ROOT} AS source, {_ROOT} AS node"


@query(f"WITH {THREE}, {_levels('SELECT src AS a, dst AS b, 1 AS m FROM tr', 'SELECT node AS source, node FROM tn', 12)} SELECT source AS query, node, level::INT AS level FROM l")
def bfs_batch(spark, d):
    t = trade(spark, d, 3)
    return traversal.bfs_batch(t, sorted(r[0] for r in t.vertices.collect()))


@query(f"WITH {THREE}, {_relaxed(_ARCS, _FROM_ROOT, 14)} SELECT row_number() OVER (ORDER BY cost, node) - 1 AS place, node, cost FROM d")
def dijkstra_order(spark, d):
    t = trade(spark, d, 3)
    return number_rows(paths.settled(t, _root(t), "w").select("node", F.col("cost").cast("long").alias("cost")), ["cost", "node"], "place").select("place", "node", "cost")


@query(f"WITH {THREE}, {_relaxed('SELECT src AS a, dst AS b, 2 * w + 1 AS w FROM tr', _FROM_ROOT, 14)} SELECT node, (cost / 4.0)::DOUBLE AS cost FROM d")
def dijkstra_measure(spark, d):
    """Costs that aren't whole."""
    t = trade(spark, d, 3)
    return paths.sssp(t, _root(t), "w / 2 + 0.25", "f64").table.select("node", "cost")


@query(f"WITH {THREE}, {_relaxed('SELECT src AS a, dst AS b, w + 3 * (src - dst) AS w FROM tr', _FROM_ROOT, 14)} SELECT node, cost, node <> {_ROOT} AS has_predecessor, true AS tight FROM d")
def spfa(spark, d):
    """Signed costs, and whether each node's predecessor explains its cost."""
    t = trade(spark, d, 3)
    x = paths.spfa(t, _root(t), "w + 3 * (src - dst)").table
    y = x.join(x.select(F.col("node").alias("parent"), F.col("cost").alias("before")), "parent", "left").join(t.edges.select(F.col("edge").alias("via"), (F.col("w") + 3 * (F.col("src") - F.col("dst"))).alias("w")), "via", "left")
    return y.select("node", "cost", F.col("parent").isNotNull().alias("has_predecessor"), F.coalesce(F.col("before") + F.col("w") == F.col("cost"), F.lit(True)).alias("tight"))


def _pair_rows(spark: SparkSession, t: Topology, f) -> DataFrame:
    """(target, cost, valid) of paths from the root to the first and the last nation that it sells to by one other nation only."""
    root = _root(t)
    rows = []
    weight = {(r["src"], r["dst"]): r["w"] for r in t.edges.collect()}
    direct = {b for a, b in weight if a == root}
    reached = sorted(x for (x,) in traversal.bfs(t, root, max_depth=2).select("node").collect() if x != root and x not in direct)
    for x in sorted({*reached[:1], *reached[-1:]}):
        path, cost = f(root, x)
        steps = list(zip(path, path[1:], strict=False))
        rows.append((x, cost, path[0] == root and path[-1] == x and all(s in weight for s in steps) and sum(weight[s] for s in steps) == cost))
    return _rows(spark, rows, "target long, cost long, valid boolean")


_TWO = f"""WITH {THREE}, {_relaxed(_ARCS, _FROM_ROOT, 14)}, c AS (SELECT node, cost FROM d WHERE node <> {_ROOT} AND node NOT IN (SELECT dst FROM tr WHERE src = {_ROOT}) AND node IN (SELECT y.dst FROM tr x JOIN tr y ON y.src = x.dst WHERE x.src = {_ROOT}))
SELECT node AS target, cost, true AS valid FROM c WHERE node IN (SELECT min(node) FROM c) OR node IN (SELECT max(node) FROM c)"""


@query(_TWO)
def bidirectional_dijkstra(spark, d):
    t = trade(spark, d, 3)
    return _pair_rows(spark, t, lambda s, x: paths.bidirectional_dijkstra(t, s, x, "w"))


@query(_TWO)
def astar(spark, d):
    """With half the remaining cost as heuristic, so that much is pruned."""
    t = trade(spark, d, 3)

    def find(s, x):
        rest = paths.sssp(t.reversed(), x, "w").table.select("node", F.floor(F.col("cost") / 2).alias("h"))
        return paths.astar(t, s, x, "w", materialize(rest, "heuristic"))

    return _pair_rows(spark, t, find)


@query(f"WITH {THREE}, {_levels('SELECT src AS a, dst AS b, 1 AS m FROM tr', _FROM_ROOT, 12)} SELECT node, level::INT AS level, (SELECT count(*) FROM tr WHERE src = l.node) AS degree FROM l")
def traversal_cache(spark, d):
    t = trade(spark, d, 3)
    cache = TraversalCache.of(t, "compact")
    return cache.bfs(_root(t)).select("node", "level").join(cache.topology.degrees(), "node")


@query(f"WITH {T.TYPE_FLOW}, s AS (SELECT range AS s FROM range(1, 31)), c AS (SELECT s, sum(CASE WHEN ((s >> src) & 1) = 1 AND ((s >> dst) & 1) = 0 THEN n ELSE 0 END) AS w FROM s, fe WHERE (s & 1) = 1 AND (s & 16) = 0 GROUP BY 1) SELECT unnest(['dinic', 'edmonds_karp', 'push_relabel', 'cheapest']) AS method, min(w)::BIGINT AS value, true AS feasible FROM c")
def flow_methods(spark, d):
    """Each flow's value, and whether it keeps to capacities and balances; the cheapest one leaves no cheaper cycle."""
    t = T.type_flow(spark, d)
    rows = []
    for name in ("dinic", "edmonds_karp", "push_relabel", "cheapest"):
        if name == "cheapest":
            value, price, flows = structure.min_cost_max_flow(t, 0, 4, "n", "edge")
        else:
            value, flows, _ = {"dinic": structure.maximum_flow, "edmonds_karp": structure.edmonds_karp, "push_relabel": structure.push_relabel}[name](t, 0, 4, "n")
        x = {r["edge"]: (r["src"], r["dst"], r["n"], int(r["flow"])) for r in t.edges.join(flows, "edge").collect()}
        net = dict.fromkeys(range(5), 0)
        for s, e, _, f in x.values():
            net[s] += f
            net[e] -= f
        ok = all(0 <= f <= n for _, _, n, f in x.values()) and net == {0: value, 1: 0, 2: 0, 3: 0, 4: -value}
        if name == "cheapest":
            left = [(s, e, k) for k, (s, e, n, f) in x.items() if f < n and s != e] + [(e, s, -k) for k, (s, e, n, f) in x.items() if f and s != e]
            try:
                paths.all_pairs(Topology.from_edges(spark, 5, left, ("c",)), "c").count()
            except errors.NegativeCycle:
                ok = False
            ok = ok and price == sum(k * f for k, (_, _, _, f) in x.items())
        rows.append((name, int(value), ok))
    return _rows(spark, rows, "method string, value long, feasible boolean")


# Views, stores and forms ---------------------------------------------------------------------------------------------


@query(f"WITH {THREE} SELECT i.node AS i, j.node AS j, (i.node, j.node) IN (SELECT src, dst FROM tr) AS found FROM tn i, tn j")
def bit_matrix(spark, d):
    """Every cell, of the matrix as its JSON text has it."""
    t = trade(spark, d, 3)
    m = matrix.BitMatrix.from_json(spark, matrix.BitMatrix.from_topology(t).to_json())
    v = [r[0] for r in t.vertices.collect()]
    return m.lookup(_rows(spark, [(i, j) for i in v for j in v], "i long, j long"))


@query(f"WITH {THREE} SELECT src AS i, dst AS j, w::DOUBLE AS value FROM tr WHERE src <> 3 UNION ALL SELECT dst, src, -1.0 FROM tr WHERE src = {_ROOT} AND (dst, src) NOT IN (SELECT src, dst FROM tr) AND dst <> 3")
def dense_matrix_cells(spark, d):
    """Cells written, read back, written again beside them where none was, and a row removed."""
    t = trade(spark, d, 3)
    m = matrix.DenseMatrix.empty(spark, 25).insert_all(t.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("value")))
    m = matrix.DenseMatrix.from_json(spark, m.to_json())
    back = t.edges.where(F.col("src") == _root(t)).select(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(-1.0).alias("value")).join(m.cells.select("i", "j"), ["i", "j"], "left_anti")
    m = m.insert_all(materialize(back, "cells"))
    return reduce(lambda x, j: x.remove(3, j), [r[0] for r in m.outgoing(3).select("j").collect()], m).edges()


@query(f"WITH {THREE} SELECT edge, src, dst, 25::BIGINT AS nodes FROM tr")
def topology_json(spark, d):
    t = trade(spark, d, 3)
    g = graph_json.topology_from_json(spark, graph_json.topology_to_json(t)).checked()
    return g.edges.withColumn("nodes", F.lit(g.node_count()).cast("long")).select("edge", "src", "dst", "nodes")


@query(f"WITH {T.TYPE_FLOW} SELECT node, (SELECT count(*) FROM fe WHERE src = node) + (SELECT count(*) FROM fe WHERE dst = node) AS degree FROM fy")
def undirected_degrees(spark, d):
    """A loop counts twice."""
    return T.type_flow(spark, d).undirected().degrees()


@query(f"WITH {THREE} SELECT 'out' AS side, edge, dst AS neighbour FROM tr WHERE src = {_ROOT} UNION ALL SELECT 'in', edge, src FROM tr WHERE dst = {_ROOT}")
def neighbours(spark, d):
    t = trade(spark, d, 3)
    root = _root(t)
    out, into = (t.neighbours(root, x).select("edge", "neighbour") for x in ("outgoing", "incoming"))
    return out.withColumn("side", F.lit("out")).unionByName(into.withColumn("side", F.lit("in"))).select("side", "edge", "neighbour")


@query(f"WITH {THREE}, k AS (SELECT n_nationkey::BIGINT AS node, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation WHERE n_regionkey <> 1) SELECT a.idx AS src, b.idx AS dst FROM tr JOIN k a ON a.node = src JOIN k b ON b.node = dst UNION ALL SELECT count(*) - 1, count(*) - 1 FROM k")
def stable_store(spark, d):
    """Nations and trade in a keyed store; a region is removed, a loop added to the last nation left, then it is frozen."""
    t = trade(spark, d, 3)
    region = {r["n_nationkey"]: r["n_regionkey"] for r in T.table(spark, d, "nation").collect()}
    store = mutable.KeyedGraph(spark)
    for n in sorted(region):
        store.insert_node(n, {"region": region[n]})
    for e in t.edges.orderBy("edge").collect():
        store.add_edge(e["src"], e["dst"], e["w"])
    for n in sorted(region):
        if region[n] == 1:
            store.remove_node(n)
    last = max(n for n in region if region[n] != 1)
    store.add_edge(last, last)
    same = store.graph.map_payloads(lambda x: x["region"], lambda w: w)
    return same.freeze()[0].edges.select("src", "dst")


@query(f"WITH {T.EVIDENCE} SELECT edge, source, target, kind FROM ve")
def graph_builder(spark, d):
    """The canonical graph again, from its own rows in another order and twice."""
    g = T.evidence(spark, d)
    b = GraphBuilder(spark).add_edge(g.edges.orderBy(F.desc("edge"))).add_edge(g.edges).add_node(g.nodes.orderBy(F.desc("idx"))).add_node(g.nodes)
    return b.build().edges.select("edge", "source", "target", "kind")


@query(f"WITH {T.EVIDENCE} SELECT edge, source, target, kind, evidence, confidence, detail FROM ve")
def parquet_round_trip(spark, d):
    import uuid

    path = f"{folder(spark)}/graph-{uuid.uuid4().hex}"
    graph_json.write_parquet(T.evidence(spark, d), path)
    p = F.col("provenance")
    return graph_json.read_parquet(spark, path).edges.select("edge", "source", "target", "kind", p["evidence"].alias("evidence"), p["confidence"].alias("confidence"), p["detail"].alias("detail"))


_SAID = ["exact", "EXTRACTED", " Medium ", "inferred"]


def _legacy(spark: SparkSession, d: str):
    """Regions and nations as a document of the older form."""
    nation, region = T.table(spark, d, "nation"), T.table(spark, d, "region")
    odd = F.col("n_nationkey") % 2 == 1
    ids = F.concat(F.lit("src/"), "n_name", F.when(odd, "#part").otherwise(""))
    point = lambda a: F.struct(F.lit(a).cast("long").alias("line"), F.lit(4).cast("long").alias("character"))
    span = F.when(F.col("n_nationkey") % 3 == 0, F.struct(point(2).alias("start"), point(5).alias("end")))
    n = nation.select(F.to_json(F.struct(ids.alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "kind").alias("type"), F.when(odd, F.col("n_name")).alias("source_file"), span.alias("source_range"))).alias("x"))
    r = region.select(F.to_json(F.struct(F.concat(F.lit("region/"), "r_name").alias("id"), F.col("r_name").alias("label"), F.lit("area").alias("kind"))).alias("x"))
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID], F.lit(None).cast("string")), F.col("n_regionkey").cast("int") + 1)
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.struct(ids.alias("source"), F.concat(F.lit("region/"), "r_name").alias("target"), F.when(odd, "lies_in").alias("relation"), said.alias("confidence"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") + 1).alias("line"))).alias("x"))
    whole = n.unionByName(r).agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("n")).crossJoin(links.agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("l")))  # one row each
    return legacy.from_legacy(whole.select(F.concat(F.lit('{"nodes":['), "n", F.lit('],"links":['), "l", F.lit('],"version":1}')).alias("value")))


@query("""SELECT 'src/' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN '#part' ELSE '' END AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'part' ELSE n_name END AS label,
CASE WHEN n_nationkey % 5 = 0 THEN 'kind' WHEN n_nationkey % 2 = 1 THEN 'function' ELSE 'file' END AS kind, CASE WHEN n_nationkey % 6 = 3 THEN 3::BIGINT END AS line, CASE WHEN n_nationkey % 2 = 1 THEN '{"source_file":"' || n_name || '"}' END AS attributes FROM nation
UNION ALL SELECT 'region/' || r_name, r_name, 'area', NULL, NULL FROM region""")
def legacy_nodes(spark, d):
    n = _legacy(spark, d).nodes
    return n.select("id", "label", "kind", F.col("span.start.line").alias("line"), "attributes")


@query("""SELECT 'src/' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN '#part' ELSE '' END AS source, 'region/' || r_name AS target, CASE WHEN n_nationkey % 2 = 1 THEN 'lies_in' ELSE 'references' END AS kind,
['exact', 'EXTRACTED', 'EXTRACTED', 'inferred', 'EXTRACTED'][n_regionkey + 1] AS said, ['exact', 'high', 'medium', 'low', 'high'][n_regionkey + 1] AS confidence, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey + 1)::BIGINT END AS line
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def legacy_edges(spark, d):
    p = F.col("provenance")
    e = _legacy(spark, d).edges
    return e.select("source", "target", "kind", p["evidence"].alias("said"), p["confidence"].alias("confidence"), p["span"]["start"]["line"].alias("line"))


@query(f"WITH {THREE} SELECT n_nationkey::BIGINT AS node, n_name AS name, (SELECT coalesce(sum(w), 0)::BIGINT FROM tr WHERE src = n_nationkey) AS sold FROM nation")
def payloads(spark, d):
    t = trade(spark, d, 3)
    names = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    g = mutable.with_payload(t, names, t.edges.select("edge", (F.col("w") * 1).alias("value")))
    sold = g.edges.groupBy(F.col("src").alias("node")).agg(F.sum("value").alias("sold"))
    return g.vertices.join(sold, "node", "left").select("node", "name", F.coalesce("sold", F.lit(0)).cast("long").alias("sold"))


@query(f"WITH {THREE} SELECT x.src AS p0, x.dst AS p1, y.dst AS p2 FROM tr x JOIN tr y ON y.src = x.dst AND y.dst <> x.src WHERE (SELECT count(*) FROM tr z WHERE (z.src, z.dst) IN ((x.dst, x.src), (y.dst, y.src), (x.src, y.dst), (y.dst, x.src))) = 0")
def induced_paths(spark, d):
    """Paths of two edges with nothing else between their nodes."""
    return spanning.subgraph_isomorphisms([(0, 1), (1, 2)], 3, trade(spark, d, 3), induced=True).select("p0", "p1", "p2")
