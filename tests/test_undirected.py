"""Undirected operators on the literal graphs of FIXTURES.md section 3, and brute force on small random graphs."""

import itertools
import random

import pytest

from lodestone.graph import Topology
from lodestone.kernels import cuts, flow, walk
from lodestone.kernels import enumerate as listing
from lodestone.kernels.small import Small
from lodestone.operators import spanning as SP
from lodestone.operators import structure as S
from lodestone.operators.centrality import distance_analytics, edge_betweenness


def topo(spark, n, edges, names=()):
    return Topology.from_edges(spark, n, edges, names, directed=False)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_cuts(spark):
    t = topo(spark, 4, [(0, 1), (1, 2), (2, 0), (1, 3)])
    assert ids(S.bridges(t)) == [3] and ids(S.articulation_points(t)) == [1]
    assert sorted((r[0], r[1]) for r in S.biconnected_components(t).collect()) == [(0, 0), (0, 1), (0, 2), (3, 3)]
    assert ids(S.chain_decomposition(t).select("edge")) == [0, 1, 2]
    assert S.chain_decomposition(t, 9) is None
    assert S.stoer_wagner(t) == (1.0, [3])
    assert S.stoer_wagner(topo(spark, 3, [(0, 1)])) == (0, [2])
    assert ids(S.bridges(topo(spark, 2, [(0, 1), (0, 1)]))) == []


def test_matching_and_colours(spark):
    t = topo(spark, 6, [(0, 3), (0, 4), (1, 3), (1, 5), (2, 4)])
    assert [r["side"] for r in SP.bipartite_partition(t).orderBy("node").collect()] == [0, 0, 0, 1, 1, 1]
    assert S.maximum_bipartite_matching(t).count() == 3
    tri = topo(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert SP.bipartite_partition(tri) is None and SP.bipartite_partition(topo(spark, 1, [(0, 0)])) is None
    assert S.maximum_bipartite_matching(tri) is None and S.maximum_matching(tri).count() == 1
    assert S.dsatur(topo(spark, 1, [(0, 0)])) is None and S.dsatur(tri).select("colour").distinct().count() == 3
    t = topo(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)])
    assert sorted(r[0] for r in S.maximal_cliques(t).collect()) == [[0, 1, 2], [2, 3, 4], [5]]
    got, more = S.maximal_cliques(t, 1)
    assert got.count() == 1 and more


def test_trees(spark):
    t = topo(spark, 6, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 4, 5), (4, 3, 5), (2, 5, 1)], ("w",))
    assert S.steiner_tree(t, [0, 3, 5], "w") == (4, [0, 1, 2, 5])
    small = topo(spark, 3, [(0, 1)])
    assert S.steiner_tree(small, [0, 2]) is None and S.steiner_tree(small, [99]) is None and S.steiner_tree(small, [1, 1]) == (0, [])
    assert ids(SP.minimum_spanning_forest(t, "w").select("edge")) == [0, 1, 2, 3, 5]
    row = SP.forest_summary(small, "1").first()
    assert (int(row[0]), row[1], row[2]) == (1, 1, 2)


def test_distances(spark):
    line = topo(spark, 3, [(0, 1), (1, 2)])
    d = {r["node"]: (r["eccentricity"], r["center"]) for r in distance_analytics(line).collect()}
    assert d == {0: (2, False), 1: (1, True), 2: (2, False)}
    assert distance_analytics(topo(spark, 3, [(0, 1)])) is None
    assert [r["score"] for r in edge_betweenness(line).orderBy("edge").collect()] == [2, 2]
    assert [round(r["score"], 6) for r in edge_betweenness(line, True).orderBy("edge").collect()] == [round(2 / 3, 6)] * 2


def small(rng, n, m, loops=True):
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    e = e if loops else [x for x in e if x[0] != x[1]]
    return Small(list(range(n)), e, list(range(len(e))))


def components(n, edges):
    root = list(range(n))
    for u, v in edges:
        a, b = root[u], root[v]
        root = [a if x == b else x for x in root]
    return len(set(root))


@pytest.mark.parametrize("seed", range(25))
def test_kernels_against_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    g = small(rng, n, rng.randint(0, 11))
    base = components(n, g.edges)
    bridges, joints, blocks = cuts.lowlinks(g)
    assert bridges == [k for k in range(len(g.edges)) if components(n, g.edges[:k] + g.edges[k + 1 :]) > base]
    for u in range(n):
        left = [v for v in range(n) if v != u]
        sub = [(left.index(a), left.index(b)) for a, b in g.edges if u not in (a, b)]
        alone = all(a == b for a, b in g.edges if u in (a, b))
        assert (u in joints) == (components(n - 1, sub) > base - alone)
    assert sorted(k for b in blocks for k in b) == list(range(len(g.edges)))
    chained = sorted(k for c in cuts.chains(g) for k, _, _ in c)
    assert chained == sorted(set(range(len(g.edges))) - set(bridges))
    pairs = cuts.maximum_matching(g)
    assert len({x for p in pairs for x in p}) == 2 * len(pairs)
    simple = sorted({(min(e), max(e)) for e in g.edges if e[0] != e[1]})
    best = max((len(c) for r in range(len(simple) + 1) for c in itertools.combinations(simple, r) if len({x for e in c for x in e}) == 2 * r), default=0)
    assert len(pairs) == best
    near = [set(x) for x in g.simple()]
    sets = [set(c) for r in range(1, n + 1) for c in itertools.combinations(range(n), r) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    assert sorted(map(sorted, (s for s in sets if not any(s < t for t in sets)))) == sorted(cuts.maximal_cliques(g, None))
    if n > 1:
        w = [rng.randint(1, 5) for _ in g.edges]
        got = cuts.stoer_wagner(g, w)
        want = min(sum(x for (a, b), x in zip(g.edges, w, strict=True) if (a in s) != (b in s)) for r in range(1, n) for s in map(set, itertools.combinations(range(n), r)))
        assert got[0] == want
    colour = cuts.dsatur(small(rng, n, 9, False))
    assert colour is not None


@pytest.mark.parametrize("seed", range(25))
def test_directed_kernels_against_brute_force(seed):
    rng = random.Random(100 + seed)
    n = rng.randint(2, 6)
    g = small(rng, n, rng.randint(1, 12))
    cap = [rng.randint(0, 6) for _ in g.edges]
    value, flows, side = flow.maximum_flow(g, 0, n - 1, cap)
    cut = min(sum(c for (a, b), c in zip(g.edges, cap, strict=True) if a in s and b not in s) for r in range(n - 1) for s in ({0, *x} for x in itertools.combinations(range(1, n - 1), r)))
    assert value == cut == sum(c for (a, b), c in zip(g.edges, cap, strict=True) if a in side and b not in side)
    for u in range(1, n - 1):
        assert sum(f for (a, _), f in zip(g.edges, flows, strict=True) if a == u) == sum(f for (_, b), f in zip(g.edges, flows, strict=True) if b == u)
    cheap = flow.minimum_cost_flow(g, 0, n - 1, cap, [rng.randint(0, 5) for _ in g.edges])
    assert cheap[0] == value
    # circuits: every cyclic order from its smallest node
    arcs = set(g.edges)
    want = sorted([*p, p[0]] for r in range(1, n + 1) for c in itertools.combinations(range(n), r) for rest in itertools.permutations(c[1:]) for p in [(c[0], *rest)] if all(x in arcs for x in zip(p, (*p[1:], p[0]), strict=True)))
    got, more = listing.circuits(g, 10_000)
    assert sorted(got) == [list(x) for x in want] and not more
    gone = set(walk.feedback_arcs(g))
    left = [e for k, e in enumerate(g.edges) if k not in gone]
    assert walk.find_cycle(Small(g.names, left, list(range(len(left))))) is None
    assert (walk.find_cycle(g) is None) == (not want)
    idom = walk.immediate_dominators(g, 0)

    def reach(without):
        seen, stack = {0}, [0]
        while stack:
            for a, b in g.edges:
                if a == stack[-1] and b not in seen and b != without:
                    seen.add(b)
                    stack.append(b)
                    break
            else:
                stack.pop()
        return seen

    for u in idom:
        strict = {d for d in idom if d != u and (d == 0 or u not in reach(d))}
        chain, at = set(), u
        while idom[at] is not None:
            at = idom[at]
            chain.add(at)
        assert chain == (strict if u else set())
    perm = list(range(n))
    rng.shuffle(perm)
    moved = [(perm[a], perm[b]) for a, b in g.edges]
    assert listing.isomorphic(n, g.edges, moved)
    e = list(g.edges)
    e[0] = ((e[0][0] + 1) % n, e[0][1])
    brute = any(sorted((p[a], p[b]) for a, b in g.edges) == sorted(e) for p in itertools.permutations(range(n)))
    assert listing.isomorphic(n, g.edges, e) == brute
