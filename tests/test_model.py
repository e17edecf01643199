"""The evidence model, codecs, generators, stores, matrices and streams."""

import json

import pytest

from lodestone import errors, schema
from lodestone.functions import generators as G
from lodestone.functions.attributes import canonical, order_key
from lodestone.functions.filters import EdgeFilter
from lodestone.graph import EvidenceGraph, GraphBuilder, Topology
from lodestone.operators import mutable as M
from lodestone.operators import setops
from lodestone.operators import traversal as T
from lodestone.operators.matrix import BitMatrix, DenseMatrix
from lodestone.sources import graph_json as J
from lodestone.sources import text_formats as X
from lodestone.sources.legacy import from_legacy


def node(i, **kw):
    return {"id": i, "label": i.upper(), "kind": "function"} | kw


def edge(s, t, kind="calls", evidence="parsed", confidence="high", extractor="parser", detail=None, **kw):
    return {"source": s, "target": t, "kind": kind, "provenance": (extractor, evidence, confidence, None, detail)} | kw


def build(spark, nodes, edges):
    b = GraphBuilder(spark)
    for e in edges:
        b.add_edge(e)
    for n in nodes:
        b.add_node(n)
    return b.build()


def test_canonical_order(spark):
    nodes, edges = [node("beta"), node("alpha"), node("gamma"), node("alpha")], [edge("beta", "gamma"), edge("alpha", "beta", detail="line 1"), edge("alpha", "beta", detail="line 1"), edge("alpha", "beta", detail="line 2"), edge("alpha", "beta", kind="zzz"), edge("alpha", "beta", kind="contains")]
    g, h = build(spark, nodes, edges), build(spark, nodes[::-1], edges[::-1])
    assert J.to_json(g) == J.to_json(h)
    assert [r["id"] for r in g.nodes.orderBy("idx").collect()] == ["alpha", "beta", "gamma"]
    assert [(r["kind"], r["provenance"]["detail"]) for r in g.edges.orderBy("edge").collect()] == [("contains", None), ("calls", "line 1"), ("calls", "line 2"), ("zzz", None), ("calls", None)]
    again = J.from_json(spark.createDataFrame([(J.to_json(g),)], "value string"))
    assert J.to_json(again) == J.to_json(g)


@pytest.mark.parametrize("nodes, edges, error", [
    ([node("")], [], errors.EmptyNodeId),
    ([node("a", kind=" x")], [], errors.InvalidKind),
    ([node("a", language="")], [], errors.InvalidKind),
    ([node("a"), node("a", label="other")], [], errors.ConflictingNode),
    ([node("a")], [edge("x", "missing")], errors.MissingEdgeSource),
    ([node("a")], [edge("a", "missing")], errors.MissingEdgeTarget),
    ([node("a")], [edge("a", "a", extractor="")], errors.EmptyExtractor),
    ([node("a", span=("f", (1, 2), (1, 1)))], [], errors.InvalidSpan),
    ([node("a", span=("f", (0, 1), (1, 1)))], [], errors.InvalidSpan),
])
def test_validation(spark, nodes, edges, error):
    with pytest.raises(error):
        build(spark, nodes, edges)


def test_filters_and_names(spark):
    g = build(spark, [node(x) for x in "abcd"], [edge("a", "b"), edge("b", "c", kind="references"), edge("a", "d", confidence="low")])
    f = EdgeFilter().with_kind("calls").with_evidence("parsed").with_extractor("parser").with_minimum_confidence("high")
    kept = g.filter_edges(f.matches())
    ids = lambda df: [r["node_id"] for r in kept.named(df).orderBy("position").collect()]
    assert ids(T.bfs(kept.topology, g.node_index("a"))) == ["a", "b"]
    assert ids(T.bfs(g.topology, g.node_index("a"))) == ["a", "b", "d", "c"]
    assert ids(T.bfs(g.topology, g.node_index("c"), "incoming")) == ["c", "b", "a"]
    assert g.node_index("nope") is None and [r["target"] for r in g.outgoing("a").collect()] == ["b", "d"]
    other = build(spark, [node("c"), node("e")], [edge("c", "e")])
    u = setops.union(g, other)
    assert [r["id"] for r in u.vertices.orderBy("node").collect()] == list("abcde") and u.edge_count() == 4


def test_attributes():
    assert canonical('{"b":1,"a":[1,null,{"z":2.5}]}') == '{"a":[1,null,{"z":2.5}],"b":1}' and canonical("{}") is None
    values = ["null", "false", "true", "-5", "7", "18446744073709551615", "-1.5", "-0.0", "0.0", "1.25", '"a"', '"b"', "[]", "[1]", "{}", '{"a":1}']
    keys = [order_key(f'{{"k":{v}}}') for v in values]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    with pytest.raises(errors.InvalidFormat):
        canonical('{"a":NaN}')


def test_documents_are_bounded(spark):
    """A graph of many elements is several documents, none with more elements than allowed, that merge into the same graph."""
    nodes = [{"id": f"n{k}", "label": "x", "kind": "file"} for k in range(25)]
    edges = [{"source": f"n{k}", "target": f"n{k // 2}", "kind": "calls", "provenance": {"extractor": "t", "evidence": "parsed", "confidence": "high"}, "attributes": {"k": k}} for k in range(25)]
    g = J.from_json(spark.createDataFrame([(json.dumps({"nodes": nodes, "edges": edges}),)], "value string"))
    docs = J.documents(g, 10)
    sizes = [max(len(json.loads(r["value"])[k]) for k in ("nodes", "edges")) for r in docs.collect()]
    assert sorted(sizes) == [0, 5, 5, 10, 10, 10, 10]
    assert J.to_json(J.from_json(docs)) == J.to_json(g)


def test_complement_writes_no_pairs(spark, monkeypatch):
    """Numbers in the order (src, dst) for ids with gaps, and only what is left out is sorted and written."""
    from lodestone import scratch
    from lodestone.plans import loop

    written = []

    def counted(df, name):
        out = scratch.materialize(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(loop, "materialize", counted)
    ids = [3, 7, 8, 20, *range(30, 60)]
    pairs = [(3, 7), (3, 7), (7, 3), (8, 8), (20, 3), (20, 59), (59, 20), (30, 31), (30, 59)]
    t = Topology(spark.createDataFrame([(x,) for x in ids], "node long"), spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge long, src long, dst long"))
    for loops in (False, True):
        want = [(a, b) for a in ids for b in ids if (loops or a != b) and (a, b) not in pairs]
        got = [tuple(r) for r in setops.complement(t, loops).edges.select("edge", "src", "dst").orderBy("edge").collect()]
        assert got == [(k, *p) for k, p in enumerate(want)]
    assert max(written) <= 2 * len(ids) + len(pairs)


def test_views(spark):
    t = Topology.from_edges(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 1)])
    assert sorted((r["src"], r["dst"]) for r in t.reversed().edges.collect()) == [(1, 0), (1, 0), (2, 1), (3, 2)]
    assert t.induced("node < 3").edge_count() == 3 and t.filter_edges("edge > 1").node_count() == 4
    assert setops.complement(t).edge_count() == 12 - 3
    assert {r["node"]: r["degree"] for r in Topology.from_edges(spark, 2, [(0, 0), (0, 1)], directed=False).degrees().collect()} == {0: 3, 1: 1}
    with pytest.raises(errors.InvalidTopologyEndpoint):
        Topology.from_edges(spark, 1, [(0, 1)])


def test_codecs(spark):
    t = Topology.from_edges(spark, 3, [(0, 1), (1, 2)])
    assert X.to_dot(t) == "strict digraph G {\n  n0;\n  n1;\n  n2;\n  n0 -> n1;\n  n1 -> n2;\n}\n"
    assert X.parse_dot(X.to_dot(t)) == (3, [(0, 1), (1, 2)])
    assert X.parse_dot('digraph { "n0" [label="root"]; n1; 2; n0 -> n1 -> 2 }') == (3, [(0, 1), (1, 2)])
    with pytest.raises(errors.InvalidFormat):
        X.parse_dot("graph { n0 -- n1 }")
    assert [X.encode_graph6(*x) for x in ((0, []), (1, []), (3, [(0, 1), (1, 2), (2, 0)]))] == ["?", "@", "Bw"]
    assert X.decode_graph6(">>graph6<<Bw") == (3, [(0, 1), (0, 2), (1, 2)])
    for n in (5, 63, 70):
        e = [(u, v) for v in range(n) for u in range(v) if (u * 7 + v * 3) % 4 == 0]
        assert X.decode_graph6(X.encode_graph6(n, e)) == (n, e)
    for bad in ("B", "Bx~", "\x01"):
        with pytest.raises(errors.InvalidFormat):
            X.decode_graph6(bad)
    with pytest.raises(errors.UnsupportedGraphFeature):
        X.encode_graph6(2, [(0, 0)])
    rows = X.read_graph6(spark.createDataFrame([("Bw",), ("@",)], "value string")).collect()
    assert sorted((r["node_count"], r["src"], r["dst"]) for r in rows if r["src"] is not None) == [(3, 0, 1), (3, 0, 2), (3, 1, 2)] and len(rows) == 4
    assert X.to_graph6(Topology.from_edges(spark, 3, [(0, 1), (1, 2), (2, 0)], directed=False)) == "Bw"
    ids, e, directed = X.parse_graphml(X.to_graphml(t))
    assert ids == ["n0", "n1", "n2"] and e == [(0, 1), (1, 2)] and directed
    for bad in ('<graphml><graph edgedefault="directed"><port/></graph></graphml>', '<graphml><graph/></graphml>', '<graphml><graph edgedefault="directed"><node id="a"/><node id="a"/></graph></graphml>'):
        with pytest.raises(errors.GraphError):
            X.parse_graphml(bad)
    assert J.topology_to_json(J.topology_from_json(spark, J.topology_to_json(t))) == J.topology_to_json(t)


def test_parquet_round_trip(spark, tmp_path):
    g = build(spark, [node("a", attributes='{"n": 18446744073709551615}'), node("b")], [edge("a", "b")])
    J.write_parquet(g, str(tmp_path / "g"))
    assert J.to_json(J.read_parquet(spark, str(tmp_path / "g"))) == J.to_json(g)
    assert '"attributes":{"n":18446744073709551615}' in J.to_json(g)


def test_legacy(spark):
    doc = {"nodes": [{"id": "src/a.rs", "source_file": "src/a.rs", "source_range": {"start": {"line": 0, "character": 0}, "end": {"line": 2, "character": 5}}, "extra": 1}, {"id": "src/a.rs#f", "type": "method"}], "links": [{"source": "src/a.rs#f", "target": "src/a.rs", "provenance": "RESOLVED", "confidence": "low", "compileOnly": True, "line": 3, "character": 1}, {"source": "src/a.rs", "target": "src/a.rs#f", "relation": "contains", "confidence": "EXACT_LSP"}], "meta": 1}
    g = from_legacy(spark.createDataFrame([(json.dumps(doc),)], "value string"), "old")
    a, f = g.nodes.orderBy("idx").collect()
    assert (a["label"], a["kind"], f["label"], f["kind"]) == ("a.rs", "file", "f", "method")
    assert a["span"]["end"]["line"] == 3 and json.loads(a["attributes"]) == {"extra": 1, "source_file": "src/a.rs"}
    down, up = g.edges.orderBy("edge").collect()
    assert (down["kind"], down["provenance"]["evidence"], down["provenance"]["confidence"]) == ("contains", "EXACT_LSP", "exact")
    assert (up["kind"], up["provenance"]["evidence"], up["provenance"]["confidence"]) == ("references", "RESOLVED", "low")
    assert up["provenance"]["span"]["file"] == "src/a.rs" and up["provenance"]["span"]["start"]["column"] == 2
    assert json.loads(up["attributes"]) == {"compileOnly": True, "line": 3, "character": 1}


def pairs(t):
    return [(r["src"], r["dst"]) for r in t.edges.orderBy("edge").collect()]


def test_generators(spark):
    assert pairs(G.path(spark, 3)) == [(0, 1), (1, 2)] and pairs(G.cycle(spark, 1)) == [(0, 0)] and pairs(G.cycle(spark, 0)) == []
    assert pairs(G.complete(spark, 3)) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert pairs(G.star(spark, 3)) == [(0, 1), (0, 2)] and pairs(G.complete_bipartite(spark, 2, 2)) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert pairs(G.grid(spark, 2, 2)) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    mask, state = (1 << 64) - 1, 42

    def draw():
        nonlocal state
        state = (state + 0x9E3779B97F4A7C15) & mask
        x = state
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) % 3 < 1

    r = G.RandomGraphs(spark, 42)
    assert pairs(r.directed(6, 1, 3)) == [(u, v) for u in range(6) for v in range(6) if u != v and draw()]
    assert r.directed(4, 1, 1).edge_count() == 12 and r.dag(4, 0, 1).edge_count() == 0
    assert pairs(r.undirected(7, 1, 3)) == [(u, v) for u in range(7) for v in range(u + 1, 7) if draw()]
    with pytest.raises(errors.InvalidProbability):
        r.dag(3, 2, 1)


def test_stores(spark):
    g = M.StableGraph(spark)
    a, b, c = (g.add_node(x) for x in "abc")
    e = g.add_edge(a, b, 1)
    f = g.add_edge(a, c, 2)
    assert g.outgoing_edges(a) == [f, e] and g.incoming_edges(b) == [e]
    assert g.remove_node(b) == "b" and g.edge(e) is None and g.remove_node(b) is None
    d = g.add_node("d")
    assert d == (b[0], b[1] + 1) and g.node(b) is None
    with pytest.raises(errors.InvalidStableKey):
        g.add_edge(a, b)
    t, nodes, edges = g.freeze()
    assert pairs(t) == [(nodes[a], nodes[c])] and edges == {f: 0}
    assert g.map_payloads(str.upper, str).node(d) == "D"
    k = M.KeyedGraph(spark)
    assert k.insert_node("x", 1) is None and k.insert_node("x", 2) == 1 and k.node("x") == 2
    with pytest.raises(errors.MissingKeyedNode):
        k.add_edge("x", "y")
    s = M.StableGraph(spark)
    p, q = s.add_node(0), s.add_node(1)
    dag = M.AcyclicGraph(s)
    pq = dag.add_edge(p, q)
    with pytest.raises(errors.CycleWouldBeCreated):
        dag.add_edge(q, p)
    dag.set_edge_endpoints(pq, q, p)
    w = M.WorkingGraph(spark)
    ka, kb = w.insert_node(node("a")), w.insert_node(node("b"))
    e1, e2 = w.insert_edge(edge("a", "b")), w.insert_edge(edge("a", "b"))
    w.replace_node(ka, node("z"))
    graph, at, keys = w.freeze()
    assert graph.edge_count() == 1 and at == {ka: 1, kb: 0} and {(r["slot"], r["edge"]) for r in keys.collect()} == {(e1[0], 0), (e2[0], 0)}
    w.remove_node(kb)
    assert w.edge(e1) is None
    log = spark.createDataFrame([(1, "upsert", "x", 1), (2, "upsert", "y", 1), (3, "remove", "x", None), (4, "upsert", "y", 5)], "seq long, op string, key string, v long")
    assert [(r["key"], r["v"]) for r in M.fold_log(log, ["key"]).collect()] == [("y", 5)]
    v = spark.range(2).selectExpr("id as node", "id * 2 as p")
    assert M.with_payload(Topology.from_edges(spark, 2, [(0, 1)]), v).vertices.columns == ["node", "p"]
    with pytest.raises(errors.PayloadCountMismatch):
        M.with_payload(Topology.from_edges(spark, 3, []), v)


def test_matrices(spark):
    m = DenseMatrix.empty(spark, 3).insert(0, 1, 2.5).insert(0, 1, 3.5).insert_undirected(1, 2, 1.0)
    assert m.get(0, 1) == 3.5 and m.get(2, 1) == 1.0 and m.get(1, 0) is None
    assert [tuple(r) for r in DenseMatrix.from_json(spark, m.to_json()).edges().collect()] == [(0, 1, 3.5), (1, 2, 1.0), (2, 1, 1.0)]
    with pytest.raises(errors.InvalidNodeIndex):
        m.insert(3, 0, 1.0)
    b = BitMatrix.from_topology(Topology.from_edges(spark, 3, [(0, 1), (0, 1), (2, 0)]))
    assert b.edge_count() == 2 and b.contains(0, 1) and not b.contains(1, 0)
    assert pairs(b.insert_undirected(1, 2).remove(0, 1).to_topology()) == [(1, 2), (2, 0), (2, 1)]
    assert [r["found"] for r in b.lookup(spark.createDataFrame([(0, 1), (1, 1)], "i long, j long")).orderBy("i").collect()] == [True, False]


def test_schema_kinds():
    assert len(schema.NODE_KINDS) == 27 and len(schema.EDGE_KINDS) == 18 and len(schema.EVIDENCE_KINDS) == 11
    assert isinstance(EvidenceGraph, type)
