"""The facade, the cache, streams, the one-roof module and the entry contract."""

import json
from types import SimpleNamespace

import pytest

from lodestone import api, errors, scratch
from lodestone.facade import NamedGraph
from lodestone.graph import Topology
from lodestone.operators.cache import TraversalCache
from lodestone.streaming import edges as stream


def graph(spark):
    prov = {"extractor": "x", "evidence": "parsed", "confidence": "high"}
    doc = {"nodes": [{"id": i, "label": i, "kind": "function"} for i in "dcba"], "edges": [{"source": s, "target": t, "kind": "calls", "provenance": prov} for s, t in ("ab", "bc", "ad")]}
    return NamedGraph.from_json(spark, json.dumps(doc))


def test_facade(spark):
    g = graph(spark)
    assert (g.node_count(), g.edge_count()) == (4, 3) and g.bfs("a") == ["a", "b", "d", "c"] and g.shortest_path("a", "c") == ["a", "b", "c"]
    assert g.topological_sort() == ["a", "b", "d", "c"] and not g.has_cycle() and g.shortest_path("c", "a") is None
    assert g.strongly_connected_components() == [["a"], ["b"], ["c"], ["d"]] and abs(sum(g.page_rank().values()) - 1) < 1e-9
    assert [e["target"] for e in g.outgoing("a")] == ["b", "d"] and set(json.loads(g.canonical())) == {"nodes", "edges"} and "n0 -> n1" in g.to_dot()
    with pytest.raises(errors.InvalidNodeIndex):
        g.bfs("nope")


@pytest.mark.parametrize("layout", ["fast", "compact"])
def test_cache(spark, layout):
    t = Topology.from_edges(spark, 9, [(0, 1), (0, 1), (0, 0), (1, 2), (2, 3), (4, 3), (3, 5), (5, 6), (6, 4), (7, 7)])
    c = TraversalCache.of(t, layout)
    assert c.neighbours(0) == [1, 1, 0] and c.degree(3, "incoming") == 2 and c.degree(8) == 0 and c.degree(99) is None
    assert c.shortest_path(0, 4) == [0, 1, 2, 3, 5, 6, 4] and c.reachable(2, 6) and not c.reachable(2, 7)
    assert c.storage_bytes() > 0 and c.fast_equivalent_bytes() == 160


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    make = lambda rows, n: spark.createDataFrame(rows, stream.CHANGE).coalesce(1).write.parquet(f"{src}/{n}")
    make([(1, "upsert", 10, 0, 1), (2, "upsert", 11, 1, 2)], 0)
    read = spark.readStream.schema(stream.CHANGE).option("recursiveFileLookup", "true").parquet(src)
    run = lambda: stream.upsert_edges(read, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    make([(3, "remove", 10, None, None), (4, "upsert", 11, 1, 5), (5, "upsert", 12, 0, 0)], 1)
    run()
    assert sorted(tuple(r)[:3] for r in stream.current_edges(spark, str(tmp_path / "out"), 1).collect()) == [(11, 1, 5), (12, 0, 0)]
    assert stream.windowed_degrees(spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 3L as src")).first()["out_degree"] == 1


def test_no_folder_of_ones_own_on_a_cluster():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(applicationId="app", master="spark://host:7077"))
    with pytest.raises(errors.InvalidAlgorithmParameter):
        scratch.folder(spark)
    spark.conf.get = lambda *_: "/shared/"
    assert scratch.folder(spark) == "/shared"


def test_entry_contract():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert "pagerank" in q and set(o) <= set(q) and all(callable(f) for f in q.values()) and all(isinstance(s, str) for s in o.values())
    assert callable(api.floyd_warshall) and "bfs" in api.__all__


def test_more_names(spark, tmp_path):
    line = Topology.from_edges(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert (api.diameter(line), api.radius(line), api.center(line), api.periphery(line), api.eccentricity(line, 1)) == (3, 2, [1, 2], [0, 3], 2)
    assert api.diameter(Topology.from_edges(spark, 2, [])) is None
    table = api.all_pairs(line, "1")
    assert api.path_between(table, 0, 3) == [0, 1, 2, 3] and api.path_between(table, 3, 0) is None
    m = api.BitMatrix.from_topology(line)
    assert api.BitMatrix.from_json(spark, m.to_json()).edge_count() == 3
    with pytest.raises(errors.InvalidFormat):
        api.BitMatrix.from_json(spark, '{"node_count": 1, "pairs": [[0, 1]]}')
    for k in range(2):
        (tmp_path / f"g{k}.dot").write_text(f"digraph {{ 0 -> {k + 1}; }}")
        (tmp_path / f"g{k}.graphml").write_text(api.to_graphml(line))
    rows = api.read_graph_files(spark, str(tmp_path / "*.dot"), "dot").collect()
    assert sorted((r["node_count"], r["src"], r["dst"]) for r in rows) == [(2, 0, 1), (3, 0, 2)]
    assert api.read_graph_files(spark, str(tmp_path / "*.graphml"), "graphml").count() == 6
