"""Directed operators on random graphs, against plain definitions: closures, removals, enumerations."""

import itertools
import random
from collections import defaultdict

import pytest

from lodestone import errors, scratch
from lodestone.graph import Topology
from lodestone.operators import components as C
from lodestone.operators import dag as D
from lodestone.operators import paths as P
from lodestone.operators import rank as R
from lodestone.operators import spanning as SP
from lodestone.operators import structure as S
from lodestone.operators import traversal as T
from lodestone.operators.centrality import betweenness, closeness, edge_betweenness, undirected_edge_betweenness
from lodestone.scratch import materialize

INF = float("inf")


def draw(seed, n, m, least=1, most=9, acyclic=False, loops=True):
    """m random edges (src, dst, w), parallel ones and loops included."""
    rng = random.Random(seed)
    out = []
    while len(out) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if acyclic and a >= b or a == b and not loops:
            continue
        out.append((a, b, rng.randint(least, most)))
    return out


def topo(spark, n, edges):
    return Topology.from_edges(spark, n, edges, ("w",))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def out_of(edges):
    a = defaultdict(list)
    for s, t, *_ in edges:
        a[s].append(t)
    return a


def reach(edges, start, without=None):
    near, seen, stack = out_of(edges), {start}, [start]
    while stack:
        for v in near[stack.pop()]:
            if v not in seen and v != without:
                seen.add(v)
                stack.append(v)
    return seen


def all_costs(n, edges):
    d = [[0 if i == j else INF for j in range(n)] for i in range(n)]
    for s, t, w in edges:
        d[s][t] = min(d[s][t], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


def test_walks(spark):
    edges = draw(1, 9, 16)
    t, near = topo(spark, 9, edges).persisted(), out_of(edges)
    order, level = [0], {0: 0}
    for u in order:
        for v in near[u]:
            if v not in level:
                level[v] = level[u] + 1
                order.append(v)
    assert [r["node"] for r in T.bfs(t, 0).orderBy("position").collect()] == order
    assert dict(rows(T.bfs(t, 0), "node", "level")) == level
    assert [r["node"] for r in T.bfs(t, 0, limit=4).orderBy("position").collect()] == order[:4]
    far = max(level, key=level.get)
    path = T.shortest_path(t, 0, far)
    assert len(path) == level[far] + 1 and all(b in near[a] for a, b in itertools.pairwise(path)) and (path[0], path[-1]) == (0, far)
    assert T.shortest_path(t, 0, 99) is None and T.reachable(t, 0, far) and T.bfs(t, 99).count() == 0
    stack, marked, walk = [0], {0}, []
    while stack:
        walk.append(stack.pop())
        fresh = [v for v in dict.fromkeys(near[walk[-1]]) if v not in marked]
        marked |= set(fresh)
        stack += fresh[::-1]
    assert [r["node"] for r in S.dfs(t, 0).orderBy("position").collect()] == walk
    assert [r["node"] for r in S.dfs(t, 0, limit=3).orderBy("position").collect()] == walk[:3]
    kinds = defaultdict(list)
    for r in S.depth_first_search(t, [0]).orderBy("seq").collect():
        kinds[r["event"]].append(r)
    assert sorted(r["target"] for r in kinds["tree_edge"]) == sorted(set(level) - {0}) and {r["source"] for r in kinds["finish"]} == set(level)
    done = {r["source"]: r["seq"] for r in kinds["finish"]}
    assert all(done[r["target"]] > r["seq"] for r in kinds["back_edge"]) and all(done[r["target"]] < r["seq"] for r in kinds["cross_forward_edge"])
    assert sum(map(len, kinds.values())) == 2 * len(level) + sum(s in level for s, *_ in edges)
    assert rows(T.bfs_batch(t, [5, 0]), "query", "node") == sorted([(0, v) for v in reach(edges, 5)] + [(1, v) for v in level])


def test_components(spark):
    edges = draw(3, 12, 18)
    t = topo(spark, 12, edges).persisted()
    to = {v: reach(edges, v) for v in range(12)}
    scc = {v: min(u for u in to[v] if v in to[u]) for v in range(12)}
    members, c = C.condensation(t)
    assert rows(members, "node", "component") == sorted(scc.items())
    assert rows(c.edges, "src", "dst") == sorted({(scc[a], scc[b]) for a, b, _ in edges if scc[a] != scc[b]}) and C.component_of(members, 7) == scc[7] and C.component_of(members, 77) is None
    both = [*edges, *((b, a, w) for a, b, w in edges)]
    assert rows(C.weakly_connected(t, "w > 5"), "node", "component") == [(v, min(reach([e for e in both if e[2] > 5], v))) for v in range(12)]
    assert D.has_cycle(t) and D.topological(t) is None
    ring = S.find_cycle(t)
    assert ring[0] == ring[-1] and all((a, b) in {e[:2] for e in edges} for a, b in itertools.pairwise(ring))
    gone = {r["edge"] for r in S.feedback_arc_set(t).collect()}
    left = [e for k, e in enumerate(edges) if k not in gone]
    assert all(a != b and a not in reach(left, b) for a, b, _ in left) and all(a == b or scc[a] == scc[b] for a, b, _ in (edges[k] for k in gone))


@pytest.mark.parametrize("kernel_edges", [0, 1_000_000])
def test_orders(spark, monkeypatch, kernel_edges):
    monkeypatch.setattr(D, "KERNEL_EDGES", kernel_edges)
    acyclic = draw(4, 9, 15, acyclic=True)
    t = topo(spark, 9, acyclic).persisted()
    generation = [0] * 9
    for a, b, _ in sorted(acyclic):
        generation[b] = max(generation[b], generation[a] + 1)
    got = {r["node"]: (r["generation"], r["position"]) for r in D.topological(t).collect()}
    assert [got[v][0] for v in range(9)] == generation and sorted(p for _, p in got.values()) == list(range(9))
    assert all(got[a][1] < got[b][1] for a, b, _ in acyclic) and S.find_cycle(t) is None and not D.has_cycle(t)
    reduced, closed = D.dag_reduction_closure(t)
    want = {(a, b) for a in range(9) for b in reach(acyclic, a) - {a}}
    assert set(rows(closed, "src", "dst")) == want
    assert set(rows(reduced, "src", "dst")) == {(a, b) for a, b in want if not any((a, x) in want and (x, b) in want for x in range(9))}
    best = [0] * 9
    for a, b, w in sorted(acyclic):
        best[b] = max(best[b], best[a] + w)
    path, cost = D.dag_longest_path(t, "w")
    assert cost == max(best) and D.dag_longest_path_length(t) == max(generation) and all((a, b) in want for a, b in itertools.pairwise(path))
    with pytest.raises(errors.CyclicGraph):
        D.longest(topo(spark, 2, [(0, 1, 1), (1, 0, 1)]))


@pytest.mark.parametrize("kernel_edges", [0, 1_000_000])
def test_queue_order(spark, monkeypatch, kernel_edges):
    """Inside a generation the order of release counts, not the node's number."""
    monkeypatch.setattr(D, "KERNEL_EDGES", kernel_edges)
    edges = draw(9, 15, 26, acyclic=True)
    swap = random.Random(9).sample(range(15), 15)
    edges = [(swap[a], swap[b], w) for a, b, w in edges]
    waiting = {v: sum(b == v for _, b, _ in edges) for v in range(15)}
    queue, near = sorted(v for v in waiting if not waiting[v]), out_of(edges)
    for u in queue:
        for v in near[u]:
            waiting[v] -= 1
            if not waiting[v]:
                queue.append(v)
    assert [r["node"] for r in D.topological(topo(spark, 15, edges)).orderBy("position").collect()] == queue


def test_costs(spark):
    edges = draw(5, 7, 16)
    t, d = topo(spark, 7, edges).persisted(), all_costs(7, edges)
    weight = defaultdict(lambda: INF)
    for a, b, w in edges:
        weight[a, b] = min(weight[a, b], w)
    x = P.sssp(t, 0, "w")
    assert rows(x.table, "node", "cost") == [(v, d[0][v]) for v in range(7) if d[0][v] < INF] and x.nodes() == [v for v in range(7) if d[0][v] < INF]
    goal = max((v for v in range(1, 7) if d[0][v] < INF), key=lambda v: d[0][v])
    path = x.path_to(goal)
    assert d[0][goal] == sum(weight[e] for e in itertools.pairwise(path)) and x.predecessor(goal) == path[-2] and x.predecessor(0) is None
    half = spark.createDataFrame([(v, int(d[v][goal] // 2) if d[v][goal] < INF else 0) for v in range(7)], "node long, h long")
    assert P.astar(t, 0, goal, "w", half)[1] == d[0][goal] and P.dijkstra(t, 3, 3, "w") == ([3], 0)
    assert P.dijkstra_measure(t, 0, goal, "w * 0.4")[1] == pytest.approx(d[0][goal] * 0.4)
    with pytest.raises(errors.InvalidAlgorithmParameter):
        P.dijkstra(t, 0, goal, "w * 0.4")
    heavy = all_costs(7, [e for e in edges if e[2] > 3])
    got = P.bidirectional_dijkstra(t.filter_edges("w > 3"), 0, goal, "w")
    assert (got[1] if got else INF) == heavy[0][goal]
    pairs = [(0, goal), (4, 2), (2, 4)]
    assert [r["cost"] for r in P.dijkstra_batch(t, pairs, "w").collect()] == [d[a][b] if d[a][b] < INF else None for a, b in pairs]
    name, table = P.all_pairs_auto(t, "w")
    assert name == "floyd_warshall" and rows(table, "src", "dst", "cost") == [(a, b, d[a][b]) for a in range(7) for b in range(7) if d[a][b] < INF]
    most = Topology.from_edges(spark, 3, [(0, 1, str(2**64 - 1)), (1, 2, "1")], ("w",), types="string")
    assert P.dijkstra(most, 0, 2, "cast(w as decimal(20,0))") is None
    with pytest.raises(errors.ArithmeticOverflow):
        P.dijkstra(t, 0, goal, "-w", "i64")


def test_signed_costs(spark):
    edges = draw(6, 7, 15)
    shift = random.Random(6).choices(range(-9, 9), k=7)
    signed = [(a, b, w + shift[a] - shift[b]) for a, b, w in edges]  # a potential closes no cycle below 0
    t, d = topo(spark, 7, signed).persisted(), all_costs(7, signed)
    x = P.bellman_ford(t, 0, "w")
    assert rows(x.table, "node", "cost") == [(v, d[0][v]) for v in range(7) if d[0][v] < INF]
    far = [v for v in range(7) if d[0][v] < INF][-1]
    assert x.path_to(far)[0] == 0 and x.distance_to(far) == d[0][far]
    assert P.bellman_ford_measure(t, 0, "w / 2").distance_to(far) == pytest.approx(d[0][far] / 2) and P.bellman_ford(t, 99, "w") is None
    n = 60
    ring = [(k, k + 1, 1) for k in range(n - 1)]  # a cycle of three behind a long way shows long before all nodes were relaxed
    bad = topo(spark, n, [*ring, (7, 5, -3), (50, 51, 1)])
    with pytest.raises(errors.NegativeCycle):
        P.bellman_ford(bad, 0, "w")
    assert P.bellman_ford(bad, 52, "w").distance_to(56) == 4
    with pytest.raises(errors.NegativeCycle):
        P.all_pairs(topo(spark, 3, [(0, 1, -2), (1, 2, 0), (2, 0, 1)]), "w").count()


def test_flows(spark):
    edges = draw(7, 7, 20)
    t = topo(spark, 7, edges)
    cut = {frozenset(s): sum(w for a, b, w in edges if a in s and b not in s) for k in range(1, 7) for s in itertools.combinations(range(7), k) if 0 in s and 6 not in s}
    for f in (S.maximum_flow, S.push_relabel):
        value, flows, side = f(t, 0, 6, "w")
        assert value == min(cut.values()) == cut[frozenset(side)]
    assert flows.count() == len(edges) and S.maximum_flow(t, 0, 99, "w") is None and S.maximum_flow(t, 0, 0, "w")[0] == 0
    value, price, flows = S.min_cost_max_flow(t, 0, 6, "w", "edge")
    assert value == min(cut.values())
    x = {r["edge"]: int(r["flow"]) for r in flows.collect()}
    assert all(0 <= x[k] <= w for k, (_, _, w) in enumerate(edges)) and price == sum(f * k for k, f in x.items())
    left = [(a, b, k) for k, (a, b, w) in enumerate(edges) if x[k] < w and a != b] + [(b, a, -k) for k, (a, b, _) in enumerate(edges) if x[k] and a != b]
    d = all_costs(7, left)
    assert all(d[v][v] >= 0 for v in range(7))  # nothing cheaper


def test_control_flow(spark):
    edges = draw(16, 11, 20)
    t, live = topo(spark, 11, edges).persisted(), reach(edges, 0)
    above = {v: {x for x in live if x == v or x == 0 or v not in reach(edges, 0, x)} for v in live}
    idom = {v: max(above[v] - {v}, key=lambda x: len(above[x])) if v else None for v in live}
    d = materialize(S.dominators(t, 0), "dominators")
    assert rows(d.where("node > 0"), "node", "idom") == sorted((v, x) for v, x in idom.items() if v) and {r["node"] for r in d.collect()} == live
    assert rows(S.dominations(d), "node", "dominator") == sorted((v, x) for v in live for x in above[v])
    deep = max(live, key=lambda v: len(above[v]))
    assert set(S.dominator_chain(d, deep)) == above[deep] and S.dominator_chain(d, 99) == [] and S.dominates(d, 0, deep) and not S.dominates(d, deep, 0)
    assert [r["node"] for r in S.dominated_by(d, 0).collect()] == sorted(v for v in live if idom[v] == 0)
    joins = {v for v in live if len({a for a, b, _ in edges if b == v and a in live}) > 1}
    want = {(x, b) for a, b, _ in edges if a in live and b in joins for x in above[a] if x == b or x not in above[b]}
    assert set(rows(S.dominance_frontiers(t, 0), "node", "frontier")) == want


def test_enumeration(spark):
    edges = draw(13, 7, 14, loops=False)
    t, near = topo(spark, 7, edges), {e[:2] for e in edges}
    cost = {e: min(w for a, b, w in edges if (a, b) == e) for e in near}
    simple = sorted([0, *mid, 6] for k in range(6) for mid in itertools.permutations(range(1, 6), k) if all(e in near for e in itertools.pairwise([0, *mid, 6])))
    found, more = S.all_simple_paths(t, 0, 6, 7, 1000)
    assert sorted(map(list, {tuple(p) for p in found})) == simple and not more and len(simple) > 2
    assert S.all_simple_paths(t, 0, 6, 7, 1)[1]
    costs = sorted(sum(cost[e] for e in itertools.pairwise(p)) for p in simple)
    assert [c for _, c in S.k_shortest_paths(t, 0, 6, 3, "w")] == costs[:3]
    rings = sorted([*c, c[0]] for k in range(2, 8) for c in itertools.permutations(range(7), k) if c[0] == min(c) and all(e in near for e in itertools.pairwise([*c, c[0]])))
    got, more = S.elementary_circuits(t, 1000)
    assert sorted(map(list, {tuple(c) for c in got})) == rings and not more
    assert S.elementary_circuits(t, 1)[1] == (len(rings) > 1)


def test_scores(spark):
    edges = draw(12, 9, 24)
    t = topo(spark, 9, edges).persisted()
    degree = [sum(a == v for a, *_ in edges) for v in range(9)]
    p = [1 / 9] * 9
    for _ in range(6):
        loose = sum(p[v] for v in range(9) if not degree[v])
        q = [0.15 / 9 + 0.85 * (loose / 9 + sum(p[a] / degree[a] for a, b, _ in edges if b == v)) for v in range(9)]
        p = [x / sum(q) for x in q]
    assert [r["score"] for r in R.page_rank(t, iterations=6).orderBy("node").collect()] == pytest.approx(p)
    ring = [*((v, (v + 1) % 9, 1) for v in range(9)), *edges]  # no node without an edge out: rounds are chained
    degree = [sum(a == v for a, *_ in ring) for v in range(9)]
    p = [1 / 9] * 9
    for _ in range(12):
        p = [0.15 / 9 + 0.85 * sum(p[a] / degree[a] for a, b, _ in ring if b == v) for v in range(9)]
    whole = topo(spark, 9, ring).persisted()
    assert [r["score"] for r in R.page_rank(whole, iterations=12).orderBy("node").collect()] == pytest.approx(p)
    assert [r["score"] for r in R.page_rank(whole, iterations=0).orderBy("node").collect()] == pytest.approx([1 / 9] * 9)
    before = set(scratch._written)
    R.eigenvector_centrality(whole, 5, 0.0)
    assert len(set(scratch._written) - before) == 2  # the arcs and the last scores
    pairs = {(a, b) for a, b, _ in edges if a != b}
    unit = lambda x: [y / sum(z * z for z in x) ** 0.5 for y in x]
    hub = [1 / 3] * 9
    for _ in range(4):
        authority = unit([sum(hub[a] for a, b in pairs if b == v) for v in range(9)])
        hub = unit([sum(authority[b] for a, b in pairs if a == v) for v in range(9)])
    got = R.hits(t, 4, 0.0).scores.orderBy("node").collect()
    assert [r["hub"] for r in got] == pytest.approx(hub) and [r["authority"] for r in got] == pytest.approx(authority)
    settled = R.hits(t, 500, 1e-2)
    assert settled.converged and 1 < settled.iterations < 500
    katz = [1.0] * 9
    for _ in range(4):
        katz = [1 + 0.01 * sum(katz[a] for a, b in pairs if b == v) for v in range(9)]
    assert [r["score"] for r in R.katz_centrality(t, 0.01, 1.0, 4, 0.0).scores.orderBy("node").collect()] == pytest.approx(katz, rel=1e-4)
    with pytest.raises(errors.InvalidAlgorithmParameter):
        R.page_rank(t, 1.5)
    d = all_costs(9, [(a, b, 1) for a, b in pairs])
    count = [[0.0] * 9 for _ in range(9)]
    for s in range(9):
        count[s][s] = 1.0
        for v in sorted(range(9), key=lambda v: d[s][v]):
            if v != s and d[s][v] < INF:
                count[s][v] = sum(count[s][a] for a, b in pairs if b == v and d[s][a] + 1 == d[s][v])
    between = [sum(count[s][v] * count[v][e] / count[s][e] for s in range(9) for e in range(9) if s != v != e != s and d[s][e] < INF and d[s][v] + d[v][e] == d[s][e]) / 56 for v in range(9)]
    assert [r["score"] for r in betweenness(t).orderBy("node").collect()] == pytest.approx(between)
    close = []
    for v in range(9):
        r = [x for x in d[v] if 0 < x < INF]
        close.append(len(r) / sum(r) * len(r) / 8 if r else 0.0)
    assert [r["score"] for r in closeness(t).orderBy("node").collect()] == pytest.approx(close)
    line = topo(spark, 3, [(0, 1, 1), (1, 2, 1)])
    assert [r["score"] for r in undirected_edge_betweenness(line).orderBy("edge").collect()] == [r["score"] for r in edge_betweenness(line.undirected()).orderBy("edge").collect()]


def test_networks(spark):
    edges = draw(13, 12, 22)
    t = topo(spark, 12, edges)
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    core, left, k = {}, set(range(12)), 0
    while left:
        low = [v for v in left if len(near[v] & left) <= k]
        for v in low:
            core[v] = k
        left -= set(low)
        k += not low
    assert rows(C.k_core(t), "node", "core") == sorted(core.items())
    basis = [r[0] for r in S.cycle_basis(t).collect()]
    parts = {min(reach([(a, b) for a in near for b in near[a]], v)) for v in range(12)}
    assert len(basis) == sum(map(len, near.values())) // 2 - 12 + len(parts) and all(len(near[v] & set(c)) >= 2 for c in basis for v in c)
    community = dict(rows(S.label_propagation(t), "node", "community"))
    for v in range(12):
        around = [community[u] for u in near[v]]
        assert not around or around.count(community[v]) == max(map(around.count, around))


def test_isomorphism(spark):
    edges = draw(14, 8, 15)
    swap = random.Random(14).sample(range(8), 8)
    t = topo(spark, 8, edges)
    assert SP.graph_isomorphic(t, topo(spark, 8, [(swap[a], swap[b], w) for a, b, w in edges]))
    a, b, w = next(e for e in edges if e[0] != e[1])
    assert not SP.graph_isomorphic(t, topo(spark, 8, [(a, a, w) if e == (a, b, w) else e for e in edges]))
    pairs, pattern = {e[:2] for e in edges}, [(0, 1), (1, 2)]
    maps = [m for m in itertools.permutations(range(8), 3) if all((m[x], m[y]) in pairs for x, y in pattern)]
    assert rows(SP.subgraph_isomorphisms(pattern, 3, t, induced=False), "p0", "p1", "p2") == sorted(maps)
    alone = [m for m in maps if [sum(e[:2] == (m[x], m[y]) for e in edges) for x in range(3) for y in range(3)] == [int((x, y) in pattern) for x in range(3) for y in range(3)]]
    assert rows(SP.subgraph_isomorphisms(pattern, 3, t, induced=True), "p0", "p1", "p2") == sorted(alone)
    first, more = SP.isomorphism_search(pattern, 3, t, 2, induced=False)
    assert rows(first, "p0", "p1", "p2") == sorted(maps)[:2] and more and not SP.isomorphism_search(pattern, 3, t, len(maps), induced=False)[1]
