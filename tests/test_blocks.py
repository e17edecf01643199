"""All-pairs operators by blocks of sources: the joins' results, and no state of all pairs is written."""

import random

import pytest

from lodestone import scratch
from lodestone.graph import Topology
from lodestone.kernels import blocks
from lodestone.operators import centrality, paths, traversal

N = 40


def graph(spark):
    rng = random.Random(5)
    edges = [(k, k + 1, 3) for k in range(N - 1)] + [(rng.randrange(N), rng.randrange(N), rng.randint(0, 30)) for _ in range(80)] + [(k, 0, 40) for k in range(N)]
    rows = [(k, 7 * a + 3, 7 * b + 3, w) for k, (a, b, w) in enumerate(edges)]
    return Topology(spark.createDataFrame([(7 * k + 3,) for k in range(N)], "node long"), spark.createDataFrame(rows, "edge long, src long, dst long, w long")).persisted()


RUNS = {
    "all_pairs_johnson": lambda t: paths.all_pairs(t, "w", parents=False),
    "closeness_centrality": centrality.closeness,
    "edge_betweenness": centrality.edge_betweenness,
    "betweenness_centrality": centrality.betweenness,
    "distance_analytics": centrality.distance_analytics,
}


@pytest.mark.parametrize("name", RUNS)
def test_blocks(spark, monkeypatch, name):
    t, written = graph(spark), []

    def counted(df, label):
        out = scratch.materialize(df, label)
        written.append(out.count())
        return out

    for m in (centrality, paths, traversal):
        monkeypatch.setattr(m, "materialize", counted)
    got = sorted(tuple(r) for r in RUNS[name](t).collect())
    assert sum(written) <= 4 * t.edge_count() < N * N / 2
    written.clear()
    monkeypatch.setattr(blocks, "MOST_ARCS", -1)
    joined = sorted(tuple(r) for r in RUNS[name](t).collect())
    assert sum(written) >= N * N / 2
    assert len(got) == len(joined) and all(list(a) == pytest.approx(list(b)) for a, b in zip(got, joined, strict=True))


@pytest.mark.parametrize("name", ["closeness_centrality", "distance_analytics"])
def test_sets_of_twice_the_arcs(spark, monkeypatch, name):
    """Bit sets need less than other states, so they keep to the blocks up to twice as many arcs, in pieces."""
    t, written = graph(spark), []
    whole = sorted(tuple(r) for r in RUNS[name](t).collect())

    def counted(df, label):
        out = scratch.materialize(df, label)
        written.append(out.count())
        return out

    for m in (centrality, traversal):
        monkeypatch.setattr(m, "materialize", counted)
    monkeypatch.setattr(blocks, "SPREAD", 7)
    monkeypatch.setattr(blocks, "MOST_ARCS", t.edge_count())
    both = {(a, b) for r in t.edges.collect() for a, b in ((r.src, r.dst), (r.dst, r.src)) if a != b}
    assert name == "closeness_centrality" or len(both) > t.edge_count()
    assert sorted(tuple(r) for r in RUNS[name](t).collect()) == whole
    assert sum(written) <= 4 * t.edge_count()


def test_transitions_leave_no_table_of_the_way(spark, tmp_path, monkeypatch):
    """Of the events' tables only the edges and the vertices stay on disk."""
    import os

    from lodestone.plans import graphs

    monkeypatch.setattr(scratch, "folder", lambda _: str(tmp_path))
    t = graphs.transitions(spark, "/root/testdata/sf0.001")
    assert sorted(x.partition("-")[0] for x in os.listdir(tmp_path)) == ["edges", "vertices"]
    assert t.edge_count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() - 1
