"""The registered graph queries: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Each runs an operator over a graph of whole tables (``plans.graphs``). Floats are rounded to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import generators as G
from lodestone.functions.filters import EdgeFilter
from lodestone.operators import centrality, components, dag, matrix, mutable, paths, rank, setops, spanning, structure, traversal
from lodestone.plans import graphs as T
from lodestone.scratch import materialize
from lodestone.sources import graph_json, text_formats

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _r(c) -> F.Column:
    return F.round(c, 6)


def _first(t) -> int:
    return t.vertices.agg(F.min("node")).first()[0]


# SQL building blocks: fixed numbers of rounds, each a common table expression.


def _levels(arcs: str, start: str, rounds: int) -> str:
    """l(source, node, level, paths) by levels from start(source, node) over arcs(a, b, m)."""
    out = [f"l0 AS MATERIALIZED (SELECT source, node, 0 AS level, 1.0::DOUBLE AS paths FROM ({start}))"]
    for k in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT l.source, e.b AS node, {k} AS level, sum(l.paths * e.m)::DOUBLE AS paths FROM l{k - 1} l JOIN ({arcs}) e ON e.a = l.node WHERE (l.source, e.b) NOT IN ({seen}) GROUP BY 1, 2)")
    out.append("l AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(rounds + 1)) + ")")
    return ",\n".join(out)


def _relaxed(arcs: str, start: str, rounds: int) -> str:
    """d(source, node, cost) by rounds of relaxation over arcs(a, b, w)."""
    out = [f"d0 AS MATERIALIZED (SELECT source, node, 0::BIGINT AS cost FROM ({start}))"]
    for k in range(1, rounds + 1):
        out.append(f"d{k} AS MATERIALIZED (SELECT source, node, min(cost)::BIGINT AS cost FROM (SELECT * FROM d{k - 1} UNION ALL SELECT d.source, e.b, d.cost + e.w FROM d{k - 1} d JOIN ({arcs}) e ON e.a = d.node) GROUP BY 1, 2)")
    out.append(f"d AS (SELECT * FROM d{rounds})")
    return ",\n".join(out)


_T_ARCS = "SELECT src AS a, dst AS b, count(*) AS m FROM te GROUP BY 1, 2"
_T_SIMPLE = "SELECT DISTINCT src AS a, dst AS b, 1 AS m FROM te WHERE src <> dst"
_T_START = "SELECT min(node) AS source, min(node) AS node FROM tv"
_REACH = "WITH RECURSIVE {graph}, r AS (SELECT {start} AS node UNION SELECT e.dst FROM r JOIN {edges} e ON e.src = r.node) "


# Model, filters and views ------------------------------------------------------------------------------------------


@query(f"WITH {T.EVIDENCE} SELECT edge, source, target, kind, evidence, confidence, detail FROM ve")
def evidence_edges(spark, d):
    g = T.evidence(spark, d)
    p = F.col("provenance")
    return g.edges.select("edge", "source", "target", "kind", p["evidence"].alias("evidence"), p["confidence"].alias("confidence"), p["detail"].alias("detail"))


@query(f"WITH {T.EVIDENCE} SELECT idx, id, kind FROM vn")
def evidence_nodes(spark, d):
    return T.evidence(spark, d).nodes.select("idx", "id", "kind")


@query(f"WITH {T.EVIDENCE} SELECT source, target, count(*) AS n FROM ve WHERE kind IN ('writes', 'publishes') AND evidence = 'runtime' AND cr <= 2 GROUP BY 1, 2")
def edge_filter(spark, d):
    f = EdgeFilter().with_kind("writes").with_kind("publishes").with_evidence("runtime").with_extractor("events").with_minimum_confidence("medium")
    return T.evidence(spark, d).filter_edges(f.matches()).edges.groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {T.EVIDENCE} SELECT edge, source, kind FROM ve WHERE target = 't:error'")
def incoming_edges(spark, d):
    return T.evidence(spark, d).incoming("t:error").select("edge", "source", "kind")


@query(f"WITH {T.EVIDENCE}, w AS (SELECT * FROM ve WHERE kind = 'writes'), x AS (SELECT idx, id, 0 AS side FROM vn WHERE id IN (SELECT source FROM w UNION SELECT target FROM w)), "
       "y AS (SELECT idx, id, 1 AS side FROM vn WHERE id NOT IN (SELECT id FROM x)), n AS (SELECT id, row_number() OVER (ORDER BY side, idx) - 1 AS node FROM (SELECT * FROM x UNION ALL SELECT * FROM y)) "
       "SELECT node, id, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM ve)) AS edges FROM n")
def graph_union(spark, d):
    """The graph of what is written, united with the whole."""
    from lodestone.graph import EvidenceGraph

    g = T.evidence(spark, d)
    w = g.edges.where("kind = 'writes'")
    ends = w.select(F.col("source").alias("id")).unionByName(w.select(F.col("target").alias("id"))).distinct()
    left = EvidenceGraph(g.nodes.join(ends, "id", "left_semi"), w)
    u = setops.union(left, g)
    return u.vertices.select("node", "id").withColumn("edges", F.lit(u.edge_count()).cast("long"))


@query(f"WITH {T.EVIDENCE} SELECT 'node' AS element, count(*) AS n, sum(length(id)) ::BIGINT AS chars FROM vn UNION ALL SELECT 'edge', count(*), sum(length(source) + length(target))::BIGINT FROM ve")
def json_round_trip(spark, d):
    """The graph written as JSON documents of bounded size, and read, merged, validated and numbered again."""
    g = T.evidence(spark, d)
    h = graph_json.from_json(materialize(graph_json.documents(g), "documents"))
    n = h.nodes.agg(F.lit("node").alias("element"), F.count("*").alias("n"), F.sum(F.length("id")).cast("long").alias("chars"))
    return n.unionByName(h.edges.agg(F.lit("edge").alias("element"), F.count("*").alias("n"), F.sum(F.length("source") + F.length("target")).cast("long").alias("chars")))


@query(f"WITH {T.TRANSITIONS} SELECT v.node, (SELECT count(*) FROM te WHERE dst = v.node) AS degree FROM tv v")
def reversed_degrees(spark, d):
    return T.transitions(spark, d).reversed().degrees("outgoing")


@query(f"WITH {T.TRANSITIONS}, k AS (SELECT src AS node FROM te GROUP BY 1 HAVING sum(w) >= 1000) SELECT edge, src, dst FROM te WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def induced_subgraph(spark, d):
    t = T.transitions(spark, d)
    keep = t.edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("s")).where("s >= 1000")
    return t.induced(keep).edges.select("edge", "src", "dst")


@query(f"WITH {T.TRANSITIONS} SELECT row_number() OVER (ORDER BY x.node, y.node) - 1 AS edge, x.node AS src, y.node AS dst FROM tv x, tv y WHERE x.node <> y.node AND (x.node, y.node) NOT IN (SELECT src, dst FROM te)")
def complement(spark, d):
    return setops.complement(T.transitions(spark, d)).edges.select("edge", "src", "dst")


# Traversal ---------------------------------------------------------------------------------------------------------


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_ARCS, _T_START, 8)} SELECT node, level::INT AS level FROM l")
def bfs(spark, d):
    t = T.transitions(spark, d)
    return traversal.bfs(t, _first(t)).select("node", "level")


@query(f"WITH {T.GEOGRAPHY} SELECT node, row_number() OVER (ORDER BY level, p, node) - 1 AS position, level FROM (SELECT 0::BIGINT AS node, 0 AS level, -1::BIGINT AS p UNION ALL SELECT dst, 1, src FROM ge WHERE src = 0 UNION ALL SELECT dst, 2, src FROM ge WHERE src BETWEEN 1 AND 99 UNION ALL "
       "SELECT e.dst, 3, g.src * 1000 + e.src FROM ge e JOIN ge g ON g.dst = e.src WHERE e.src >= 100)")
def bfs_order(spark, d):
    """The order of discovery on a tree."""
    return traversal.bfs(T.geography(spark, d), 0).select("node", "position", "level")


@query(_REACH.format(graph=T.TRANSITIONS + ", tf AS MATERIALIZED (SELECT DISTINCT src, dst FROM te WHERE w >= 150)", start="(SELECT min(node) FROM tv)", edges="tf") + "SELECT node FROM r")
def reachable_filtered(spark, d):
    t = T.transitions(spark, d)
    return traversal.bfs(t, _first(t), keep="w >= 150").select("node")


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_ARCS, _T_START, 8)} SELECT (SELECT max(node) FROM tv) AS target, level::BIGINT AS edges, true AS valid FROM l WHERE node = (SELECT max(node) FROM tv)")
def shortest_path(spark, d):
    t = T.transitions(spark, d)
    start, end = _first(t), t.vertices.agg(F.max("node")).first()[0]
    path = traversal.shortest_path(t, start, end)
    steps = _rows(spark, list(zip(path, path[1:], strict=False)), "src long, dst long")
    ok = steps.join(t.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").isEmpty()
    return _rows(spark, [(end, len(path) - 1, ok)], "target long, edges long, valid boolean")


# Weighted paths ----------------------------------------------------------------------------------------------------

_T_W = "SELECT src AS a, dst AS b, min(w + 1) AS w FROM te GROUP BY 1, 2"


@query(f"WITH {T.TRANSITIONS}, {_relaxed(_T_W, _T_START, 14)} SELECT node, cost FROM d")
def dijkstra(spark, d):
    t = T.transitions(spark, d)
    return paths.sssp(t, _first(t), "w + 1").table.select("node", F.col("cost").cast("long").alias("cost"))


@query(f"WITH {T.TRANSITIONS}, {_relaxed(_T_W, _T_START, 14)} SELECT node, (cost + 3 * ((SELECT min(node) FROM tv) - node))::BIGINT AS cost FROM d")
def bellman_ford(spark, d):
    """Signed weights without a negative cycle: the positive ones shifted by a potential."""
    t = T.transitions(spark, d)
    return paths.bellman_ford(t, _first(t), "w + 1 + 3 * (src - dst)").table.select("node", "cost")


@query(f"WITH {T.TRANSITIONS}, {_relaxed(_T_W, 'SELECT node AS source, node FROM tv', 12)} SELECT source AS src, node AS dst, cost FROM d")
def all_pairs_johnson(spark, d):
    return paths.all_pairs(T.transitions(spark, d), "w + 1", parents=False).select("src", "dst", "cost")


_F_ARCS = "SELECT src AS a, dst AS b, n AS w FROM fe"
_F_ALL = "SELECT node AS source, node FROM fy"


@query(f"WITH {T.TYPE_FLOW}, {_relaxed(_F_ARCS, _F_ALL, 6)} SELECT 'floyd_warshall' AS strategy, source AS src, node AS dst, cost FROM d")
def all_pairs_auto(spark, d):
    name, x = paths.all_pairs_auto(T.type_flow(spark, d), "n")
    return x.select(F.lit(name).alias("strategy"), "src", "dst", "cost")


@query(f"WITH {T.TYPE_FLOW}, {_relaxed(_F_ARCS, _F_ALL, 6)} SELECT (source * 5 + node)::BIGINT AS query, cost FROM d WHERE source <> node")
def dijkstra_batch(spark, d):
    q = [(a, b) for a in range(5) for b in range(5)]
    return paths.dijkstra_batch(T.type_flow(spark, d), q, "n").where("source <> target").select("query", F.col("cost").cast("long").alias("cost"))


_F_PATHS = """WITH RECURSIVE {flow}, p AS (SELECT [0] AS path, 0::BIGINT AS cost UNION ALL
  SELECT list_append(path, dst), cost + n FROM p JOIN fe ON fe.src = path[-1] WHERE NOT list_contains(path, dst) AND path[-1] <> 4)"""


@query(_F_PATHS.format(flow=T.TYPE_FLOW) + " SELECT array_to_string(path, '>') AS path FROM p WHERE path[-1] = 4")
def all_simple_paths(spark, d):
    found, _ = structure.all_simple_paths(T.type_flow(spark, d), 0, 4, 10, 10_000)
    return _rows(spark, [(">".join(map(str, p)),) for p in found], "path string")


@query(_F_PATHS.format(flow=T.TYPE_FLOW) + " SELECT row_number() OVER (ORDER BY cost, path) AS place, array_to_string(path, '>') AS path, cost FROM p WHERE path[-1] = 4 ORDER BY cost, p.path LIMIT 7")
def k_shortest_paths(spark, d):
    found = structure.k_shortest_paths(T.type_flow(spark, d), 0, 4, 7, "n")
    return _rows(spark, [(k + 1, ">".join(map(str, p)), c) for k, (p, c) in enumerate(found)], "place long, path string, cost long")


@query(f"WITH RECURSIVE {T.TYPE_FLOW}, p AS (SELECT src AS s, [src, dst] AS path FROM fe WHERE dst >= src UNION ALL SELECT s, list_append(path, dst) FROM p JOIN fe ON fe.src = path[-1] WHERE path[-1] <> s AND (dst = s OR (dst > s AND NOT list_contains(path, dst)))) "
       "SELECT array_to_string(path, '>') AS circuit FROM p WHERE path[-1] = s")
def elementary_circuits(spark, d):
    found, _ = structure.elementary_circuits(T.type_flow(spark, d), 100_000)
    return _rows(spark, [(">".join(map(str, c)),) for c in found], "circuit string")


# Components, order, DAGs -------------------------------------------------------------------------------------------


@query(f"WITH {T.CHAINS} SELECT src AS node, min(src) OVER (PARTITION BY cust) AS component FROM oe")
def weak_components(spark, d):
    return components.weakly_connected(T.order_chains(spark, d))


@query(f"WITH RECURSIVE {T.SUPPLY}, r AS (SELECT min(node) AS node FROM sv UNION SELECT CASE WHEN e.src = r.node THEN e.dst ELSE e.src END FROM r JOIN se e ON r.node IN (e.src, e.dst)) SELECT count(*) AS nodes, min(node) AS component FROM r")
def weak_components_supply(spark, d):
    """Line items tie all suppliers and parts together, so there is one component."""
    x = components.weakly_connected(T.supply(spark, d))
    return x.groupBy("component").agg(F.count("*").alias("nodes")).select("nodes", "component")


_SCC = "WITH RECURSIVE {graph}, tf AS MATERIALIZED (SELECT DISTINCT src, dst FROM te WHERE w >= 120), r AS (SELECT node AS s, node AS t FROM tv UNION SELECT r.s, e.dst FROM r JOIN tf e ON e.src = r.t), c AS MATERIALIZED (SELECT x.s AS node, min(x.t) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY 1)".format(graph=T.TRANSITIONS)


@query(_SCC + " SELECT node, component FROM c")
def strong_components(spark, d):
    return components.strongly_connected(T.transitions(spark, d), "w >= 120")


@query(f"WITH {T.CHAINS} SELECT src AS node, place::INT AS generation FROM oe")
def topological_generations(spark, d):
    return dag.topological(T.order_chains(spark, d)).select("node", "generation")


@query(f"WITH RECURSIVE {T.CHAINS}, q AS (SELECT src AS node, row_number() OVER (ORDER BY src) - 1 AS k, place FROM oe WHERE place = 0), "
       "h AS (SELECT o.src AS node, o.place, f.k FROM oe o JOIN oe f0 ON f0.cust = o.cust AND f0.place = 0 JOIN q f ON f.node = f0.src) SELECT node, row_number() OVER (ORDER BY place, k) - 1 AS position FROM h")
def topological_sort(spark, d):
    return dag.topological(T.order_chains(spark, d)).select("node", "position")


@query(f"WITH {T.TRANSITIONS} SELECT true AS cyclic, true AS closed, true AS real")
def find_cycle(spark, d):
    t = T.transitions(spark, d)
    c = structure.find_cycle(t)
    steps = _rows(spark, list(zip(c, c[1:], strict=False)), "src long, dst long")
    return _rows(spark, [(dag.has_cycle(t), c[0] == c[-1], steps.join(t.edges, ["src", "dst"], "left_anti").isEmpty())], "cyclic boolean, closed boolean, real boolean")


@query(f"WITH {T.CHAINS} SELECT src AS node, (sum(p) OVER (PARTITION BY cust ORDER BY place) - first_value(p) OVER (PARTITION BY cust ORDER BY place))::BIGINT AS cost FROM oe")
def dag_longest_path(spark, d):
    return dag.longest(T.order_chains(spark, d), "w").select("node", "cost")


@query(f"WITH {T.CHAINS} SELECT max(place)::BIGINT AS length FROM oe")
def dag_longest_path_length(spark, d):
    return _rows(spark, [(dag.dag_longest_path_length(T.order_chains(spark, d)),)], "length long")


@query(f"WITH {T.CHAINS} SELECT a.src, b.src AS dst FROM oe a JOIN oe b ON a.cust = b.cust AND a.place < b.place")
def transitive_closure(spark, d):
    return dag.transitive_closure(T.order_chains(spark, d)).select("src", "dst")


@query(f"WITH {T.CHAINS} SELECT src, dst FROM oe WHERE dst IS NOT NULL")
def transitive_reduction(spark, d):
    """Of the chains with an edge to every later order but one: what is left are the chains."""
    t = T.order_chains(spark, d)
    two = t.edges.alias("x").join(t.edges.alias("y"), F.col("x.dst") == F.col("y.src")).select((F.col("x.edge") + (1 << 40)).alias("edge"), F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
    from lodestone.graph import Topology

    return dag.dag_reduction_closure(Topology(t.vertices, t.edges.select("edge", "src", "dst").unionByName(two)))[0]


# Connectivity ------------------------------------------------------------------------------------------------------


_SUBSETS = "s AS (SELECT range AS s FROM range(1, 31))"


@query(f"WITH {T.TYPE_FLOW}, {_SUBSETS}, c AS (SELECT s, sum(n) AS w FROM s, fe WHERE src <> dst AND ((s >> src) & 1) <> ((s >> dst) & 1) GROUP BY 1) SELECT min(w)::DOUBLE AS weight FROM c")
def stoer_wagner(spark, d):
    return _rows(spark, [(structure.stoer_wagner(T.type_flow(spark, d).undirected(), "n")[0],)], "weight double")


@query(f"WITH {T.TYPE_FLOW}, {_SUBSETS}, c AS (SELECT s, sum(CASE WHEN ((s >> src) & 1) = 1 AND ((s >> dst) & 1) = 0 THEN n ELSE 0 END) AS w FROM s, fe WHERE (s & 1) = 1 AND (s & 16) = 0 GROUP BY 1) SELECT min(w)::BIGINT AS value, 25::BIGINT AS edges FROM c")
def maximum_flow(spark, d):
    value, flows, _ = structure.maximum_flow(T.type_flow(spark, d), 0, 4, "n")
    return _rows(spark, [(value, flows.count())], "value long, edges long")


@query(f"WITH {T.SUPPLY} SELECT node, CASE WHEN node < {T.PART} THEN 0 ELSE 1 END AS side FROM sv")
def bipartite_partition(spark, d):
    return spanning.bipartite_partition(T.supply(spark, d)).select("node", "side")


@query()
def k_core(spark, d):
    return components.k_core(T.supply(spark, d))


@query(f"WITH {T.TYPE_FLOW}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM fe WHERE src <> dst) SELECT (SELECT count(*) FROM p) - (SELECT count(*) FROM fy) + 1 AS cycles")
def cycle_basis(spark, d):
    return structure.cycle_basis(T.type_flow(spark, d)).agg(F.count("*").alias("cycles"))


# Rank, centrality, communities -------------------------------------------------------------------------------------


def _page_rank_sql(rounds: int, damping: float) -> str:
    out = ["n AS (SELECT count(*)::DOUBLE AS n FROM tv)", "o AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS d FROM te GROUP BY 1)", "a AS MATERIALIZED (SELECT te.src, te.dst, count(*) / any_value(o.d) AS share FROM te JOIN o ON o.src = te.src GROUP BY 1, 2)", "p0 AS MATERIALIZED (SELECT node, 1 / n AS score FROM tv, n)"]
    for k in range(1, rounds + 1):
        out.append(f"q{k} AS MATERIALIZED (SELECT v.node, {1 - damping} / n + {damping} * (coalesce(g.s, 0) + (SELECT coalesce(sum(score), 0) FROM p{k - 1} WHERE node NOT IN (SELECT src FROM o)) / n) AS raw FROM tv v JOIN n ON true LEFT JOIN (SELECT a.dst, sum(p.score * a.share) AS s FROM a JOIN p{k - 1} p ON p.node = a.src GROUP BY 1) g ON g.dst = v.node)")
        out.append(f"p{k} AS MATERIALIZED (SELECT node, raw / (SELECT sum(raw) FROM q{k}) AS score FROM q{k})")
    return f"WITH {T.TRANSITIONS}, " + ",\n".join(out) + f" SELECT node, round(score, 6) AS score FROM p{rounds}"


@query(_page_rank_sql(20, 0.85))
def pagerank(spark, d):
    return rank.page_rank(T.transitions(spark, d), 0.85, 20).select("node", _r("score").alias("score"))


def _hits_sql(rounds: int) -> str:
    out = ["a AS MATERIALIZED (SELECT DISTINCT src, dst FROM te WHERE src <> dst)", "h0 AS MATERIALIZED (SELECT node, 1 / sqrt((SELECT count(*) FROM tv)) AS hub, 0.0::DOUBLE AS authority FROM tv)"]
    for k in range(1, rounds + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT dst AS node, sum(hub) AS v FROM a JOIN h{k - 1} h ON h.node = a.src GROUP BY 1)")
        out.append(f"y{k} AS MATERIALIZED (SELECT node, v / (SELECT sqrt(sum(v * v)) FROM x{k}) AS v FROM x{k})")
        out.append(f"z{k} AS MATERIALIZED (SELECT src AS node, sum(y.v) AS v FROM a JOIN y{k} y ON y.node = a.dst GROUP BY 1)")
        out.append(f"h{k} AS MATERIALIZED (SELECT t.node, coalesce(z.v, 0) / (SELECT sqrt(sum(v * v)) FROM z{k}) AS hub, coalesce(y.v, 0) AS authority FROM tv t LEFT JOIN z{k} z ON z.node = t.node LEFT JOIN y{k} y ON y.node = t.node)")
    return f"WITH {T.TRANSITIONS}, " + ",\n".join(out) + f" SELECT node, round(hub, 6) AS hub, round(authority, 6) AS authority FROM h{rounds}"


@query(_hits_sql(8))
def hits(spark, d):
    return rank.hits(T.transitions(spark, d), 8, 0.0).scores.select("node", _r("hub").alias("hub"), _r("authority").alias("authority"))


def _spread_sql(start: str, step: str, rounds: int) -> str:
    out = ["a AS MATERIALIZED (SELECT DISTINCT src, dst FROM te WHERE src <> dst)", f"x0 AS MATERIALIZED (SELECT node, {start} AS v FROM tv)"]
    for k in range(1, rounds + 1):
        out.append(f"y{k} AS MATERIALIZED (SELECT x.node, x.v AS was, coalesce(g.s, 0) AS s FROM x{k - 1} x LEFT JOIN (SELECT a.dst, sum(x.v) AS s FROM a JOIN x{k - 1} x ON x.node = a.src GROUP BY 1) g ON g.dst = x.node)")
        out.append(f"x{k} AS MATERIALIZED (SELECT node, {step.format(k=k)} AS v FROM y{k})")
    return f"WITH {T.TRANSITIONS}, " + ",\n".join(out) + f" SELECT node, round(v, 6) AS score FROM x{rounds}"


@query(_spread_sql("1 / (SELECT count(*) FROM tv)::DOUBLE", "(was + s) / (SELECT sqrt(sum((was + s) * (was + s))) FROM y{k})", 10))
def eigenvector_centrality(spark, d):
    return rank.eigenvector_centrality(T.transitions(spark, d), 10, 0.0).scores.select("node", _r("score").alias("score"))


@query(_spread_sql("1.0::DOUBLE", "1 + 0.001 * s", 10))
def katz_centrality(spark, d):
    return rank.katz_centrality(T.transitions(spark, d), 0.001, 1.0, 10, 0.0).scores.select("node", _r("score").alias("score"))


@query(f"WITH {T.TRANSITIONS}, a AS (SELECT DISTINCT src AS a, dst AS b FROM te WHERE src <> dst UNION SELECT dst, src FROM te WHERE src <> dst) SELECT node, round((SELECT count(*) FROM a WHERE a = node) / ((SELECT count(*) FROM tv) - 1)::DOUBLE, 6) AS score FROM tv")
def degree_centrality(spark, d):
    return rank.degree_centrality(T.transitions(spark, d)).select("node", _r("score").alias("score"))


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_SIMPLE, 'SELECT node AS source, node FROM tv', 6)}, c AS (SELECT source, count(*) - 1 AS r, sum(level) AS total FROM l GROUP BY 1) SELECT source AS node, round(CASE WHEN r > 0 THEN r / total * (r / ((SELECT count(*) FROM tv) - 1)::DOUBLE) ELSE 0 END, 6) AS score FROM c")
def closeness_centrality(spark, d):
    return centrality.closeness(T.transitions(spark, d)).select("node", _r("score").alias("score"))


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_SIMPLE, 'SELECT node AS source, node FROM tv', 6)}, n AS (SELECT count(*)::DOUBLE AS n FROM tv), "
       "b AS (SELECT x.node, sum(x.paths * y.paths / z.paths) AS s FROM l x JOIN l y ON y.source = x.node JOIN l z ON z.source = x.source AND z.node = y.node AND z.level = x.level + y.level WHERE x.node <> x.source AND x.node <> y.node GROUP BY 1) "
       "SELECT tv.node, round(coalesce(b.s, 0) / ((n - 1) * (n - 2)), 6) AS score FROM tv JOIN n ON true LEFT JOIN b ON b.node = tv.node")
def betweenness_centrality(spark, d):
    return centrality.betweenness(T.transitions(spark, d)).select("node", _r("score").alias("score"))


_T_MULTI = "SELECT src AS a, dst AS b, count(*) AS m FROM te WHERE src <> dst GROUP BY 1, 2"


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_MULTI, 'SELECT node AS source, node FROM tv', 6)}, "
       "f AS (SELECT e.src, e.dst, sum(x.paths * y.paths / z.paths) AS s FROM (SELECT DISTINCT src, dst FROM te WHERE src <> dst) e JOIN l x ON x.node = e.src JOIN l y ON y.source = e.dst JOIN l z ON z.source = x.source AND z.node = y.node AND z.level = x.level + y.level + 1 GROUP BY 1, 2) "
       "SELECT edge, round(coalesce(f.s, 0), 4) AS score FROM te LEFT JOIN f ON f.src = te.src AND f.dst = te.dst")
def edge_betweenness(spark, d):
    return centrality.edge_betweenness(T.transitions(spark, d)).select("edge", F.round("score", 4).alias("score"))


_T_BOTH = "SELECT DISTINCT a, b, 1 AS m FROM (SELECT src AS a, dst AS b FROM te UNION ALL SELECT dst, src FROM te)"


@query(f"WITH {T.TRANSITIONS}, {_levels(_T_BOTH, 'SELECT node AS source, node FROM tv', 5)}, e AS (SELECT source AS node, max(level)::INT AS eccentricity FROM l GROUP BY 1) SELECT node, eccentricity, max(eccentricity) OVER () AS diameter, min(eccentricity) OVER () AS radius, eccentricity = min(eccentricity) OVER () AS center, eccentricity = max(eccentricity) OVER () AS periphery FROM e")
def distance_analytics(spark, d):
    return centrality.distance_analytics(T.transitions(spark, d))


@query(f"WITH {T.TRANSITIONS}, a AS MATERIALIZED (SELECT DISTINCT src, dst FROM te) SELECT x.src AS p0, count(*) AS mappings FROM a x JOIN a y ON y.src = x.dst JOIN a z ON z.src = y.dst AND z.dst = x.src WHERE x.src <> x.dst AND y.src <> y.dst AND y.dst <> x.src GROUP BY 1")
def subgraph_isomorphisms(spark, d):
    """Directed triangles by their first node."""
    return spanning.subgraph_isomorphisms([(0, 1), (1, 2), (2, 0)], 3, T.transitions(spark, d), induced=False).groupBy("p0").agg(F.count("*").alias("mappings"))


@query("SELECT true AS same, false AS other")
def graph_isomorphic(spark, d):
    """The event types' flow against itself renamed, and against itself reversed in one edge."""
    from lodestone.graph import Topology

    t = T.type_flow(spark, d)
    named = Topology(t.vertices.select((4 - F.col("node")).alias("node")), t.edges.select("edge", (4 - F.col("src")).alias("src"), (4 - F.col("dst")).alias("dst")))
    grown = Topology(t.vertices, t.edges.select("edge", "src", F.when(F.col("edge") == 1, F.col("src")).otherwise(F.col("dst")).alias("dst")))
    return _rows(spark, [(spanning.graph_isomorphic(t, named), spanning.graph_isomorphic(t, grown))], "same boolean, other boolean")


# Formats, generators, stores, matrices -----------------------------------------------------------------------------


@query(f"WITH {T.TYPE_FLOW} SELECT value FROM (SELECT 'strict digraph G {{' AS value UNION ALL SELECT '  n' || node || ';' FROM fy UNION ALL SELECT '  n' || src || ' -> n' || dst || ';' FROM fe UNION ALL SELECT '}}')")
def dot_lines(spark, d):
    return text_formats.dot_lines(T.type_flow(spark, d))


@query(f"WITH {T.TYPE_FLOW} SELECT edge, src, dst FROM fe")
def dot_round_trip(spark, d):
    return text_formats.from_dot(spark, text_formats.to_dot(T.type_flow(spark, d))).edges.select("edge", "src", "dst")


@query(f"WITH {T.GEOGRAPHY}, k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM gv) SELECT a.k AS src, b.k AS dst FROM ge JOIN k a ON a.node = ge.src JOIN k b ON b.node = ge.dst WHERE ge.dst < 1000")
def graphml_round_trip(spark, d):
    """The regions and nations."""
    t = T.nations(spark, d)
    g, _ = text_formats.from_graphml(spark, text_formats.to_graphml(t))
    return g.edges.select("src", "dst")


@query(f"WITH {T.TYPE_FLOW} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 5::BIGINT AS node_count FROM fe WHERE src <> dst")
def graph6_round_trip(spark, d):
    t = T.type_flow(spark, d)
    pairs = t.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    from lodestone.graph import Topology
    from lodestone.plans.loop import number_rows

    g6 = text_formats.to_graph6(Topology(t.vertices, number_rows(pairs, ["src", "dst"], "edge"), False))
    return text_formats.read_graph6(_rows(spark, [(g6,)], "value string")).select("src", "dst", "node_count")


@query("""WITH p AS (SELECT 'path' AS shape, range AS src, range + 1 AS dst FROM range(99) UNION ALL SELECT 'cycle', range, (range + 1) % 100 FROM range(100)
UNION ALL SELECT 'star', 0, range + 1 FROM range(99) UNION ALL SELECT 'complete', a.range, b.range FROM range(30) a, range(30) b WHERE a.range <> b.range
UNION ALL SELECT 'bipartite', a.range, 10 + b.range FROM range(10) a, range(20) b
UNION ALL SELECT 'grid', r.range * 8 + c.range, r.range * 8 + c.range + 1 FROM range(6) r, range(7) c UNION ALL SELECT 'grid', r.range * 8 + c.range, r.range * 8 + c.range + 8 FROM range(5) r, range(8) c
UNION ALL SELECT 'mesh', range % 1000, CASE WHEN ((range % 1000) * 37 + (range // 1000) * 7919 + 17) % 1000 = range % 1000 THEN (((range % 1000) * 37 + (range // 1000) * 7919 + 17) + 1) % 1000 ELSE ((range % 1000) * 37 + (range // 1000) * 7919 + 17) % 1000 END FROM range(5000))
SELECT shape, src::BIGINT AS src, dst::BIGINT AS dst FROM p""")
def generators(spark, d):
    made = {"path": G.path(spark, 100), "cycle": G.cycle(spark, 100), "star": G.star(spark, 100), "complete": G.complete(spark, 30), "bipartite": G.complete_bipartite(spark, 10, 20), "grid": G.grid(spark, 6, 8), "mesh": G.mesh(spark, 1000, 5000)}
    out = None
    for name, t in made.items():
        e = t.edges.select(F.lit(name).alias("shape"), "src", "dst")
        out = e if out is None else out.unionByName(e)
    return out


@query()
def random_graphs(spark, d):
    r = G.RandomGraphs(spark, 7)
    return r.directed(60, 1, 5).edges.unionByName(r.undirected(60, 1, 5).edges).unionByName(r.dag(60, 1, 5).edges)


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2 HAVING arg_max(value, event_id) < 100")
def change_log(spark, d):
    """Events as upserts of (user, type); values from 100 on remove the entry."""
    log = T.table(spark, d, "events").select(F.col("event_id"), F.when(F.col("value") >= 100, "remove").otherwise("upsert").alias("op"), "user_id", "event_type", "value")
    x = mutable.fold_log(log.withColumn("seq", F.col("event_id")), ["user_id", "event_type"])
    return x.select("user_id", "event_type", "value", "event_id")


@query(f"WITH {T.TYPE_FLOW} SELECT src AS i, dst AS j, (CASE WHEN src = dst THEN 0 ELSE n END)::DOUBLE AS value FROM fe")
def dense_matrix(spark, d):
    """The flow's counts, the diagonal replaced by zeros."""
    t = T.type_flow(spark, d)
    m = matrix.DenseMatrix.empty(spark, 5).insert_all(t.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("n").cast("double").alias("value")))
    return m.insert_all(t.vertices.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("value"))).edges()
