"""Operators whose order is sequential, on groups narrowed by joins first and then handed to kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.kernels import cuts, flow, walk
from lodestone.kernels import enumerate as listing
from lodestone.kernels.run import by_component, run
from lodestone.kernels.small import Small
from lodestone.operators.components import strongly_connected
from lodestone.operators.dag import cyclic_core
from lodestone.operators.spanning import bipartite_partition
from lodestone.operators.traversal import bfs
from lodestone.scratch import materialize


def _kept(t: Topology, keep) -> Topology:
    return t.filter_edges(keep) if keep is not None else t


def _reached(t: Topology, start: int, direction: str = "outgoing") -> Topology:
    """The part of ``t`` that ``start`` reaches."""
    return t.induced(materialize(bfs(t, start, direction).select("node"), "reached"))


def _between(t: Topology, source: int, target: int) -> Topology:
    """The nodes on some way from source to target."""
    to = bfs(t, source).select("node").join(bfs(t, target, "incoming").select("node"), "node")
    return t.induced(materialize(to, "between"))


def _place(g: Small, node: int) -> int | None:
    from bisect import bisect_left

    k = bisect_left(g.names, node)
    return k if k < g.n and g.names[k] == node else None


# Walks -----------------------------------------------------------------------------------------------------------


def dfs(t: Topology, start: int, direction: str = "outgoing", keep=None, limit: int | None = None) -> DataFrame:
    """(position, node) of a depth-first walk that marks nodes when it discovers them; with ``limit`` it ends after that many."""

    def kernel(g: Small):
        s = _place(g, start)
        return [] if s is None else [(k, g.names[u]) for k, u in enumerate(walk.dfs(g, s, direction, limit))]

    return run(_reached(_kept(t, keep), start, direction), kernel, "position long, node long")


def depth_first_search(t: Topology, roots: list[int] | None = None, direction: str = "outgoing", keep=None) -> DataFrame:
    """(seq, event, source, target, edge): discover, tree_edge, back_edge, cross_forward_edge and finish events."""

    def kernel(g: Small):
        starts = [p for p in (range(g.n) if roots is None else [_place(g, r) for r in roots]) if p is not None]
        return [(k, e, g.names[u], None if v is None else g.names[v], i) for k, (e, u, v, i) in enumerate(walk.dfs_events(g, starts, direction))]

    return run(_kept(t, keep), kernel, "seq long, event string, source long, target long, edge long")


def find_cycle(t: Topology, keep=None) -> list[int] | None:
    """A closed path, or None; only the peeled core is searched."""
    core = cyclic_core(t, keep)
    row = run(core, lambda g: [([g.names[u] for u in c],)] if (c := walk.find_cycle(g)) else [], "path array<long>").first()
    return None if row is None else list(row[0])


# Control flow ----------------------------------------------------------------------------------------------------


def dominators(t: Topology, root: int, keep=None) -> DataFrame:
    """(node, idom) of what ``root`` reaches; idom is null for the root; empty if it isn't a vertex."""

    def kernel(g: Small):
        r = _place(g, root)
        return [] if r is None else [(g.names[u], None if d is None else g.names[d]) for u, d in sorted(walk.immediate_dominators(g, r).items())]

    return run(_reached(_kept(t, keep), root), kernel, "node long, idom long")


def dominator_chain(idom: DataFrame, node: int, strict: bool = False) -> list[int]:
    """The node (unless strict), its immediate dominator, and so on to the root; empty if it isn't reached."""
    from lodestone.operators.traversal import follow

    if idom.where(F.col("node") == node).isEmpty():
        return []
    chain = follow(idom.withColumnRenamed("idom", "parent"), node)[::-1]
    return chain[1:] if strict else chain


def dominations(idom: DataFrame, strict: bool = False) -> DataFrame:
    """(dominator, node) of all pairs, of (node, idom): the chains of all nodes at once, by pointer doubling."""
    up = materialize(idom.where("idom is not null").select("node", F.col("idom").alias("dominator")), "up")
    pairs = up
    while not up.isEmpty():
        # up leads 2^k steps; a node's dominators at up to 2^k - 1 steps more are those of the node it leads to
        more = pairs.join(up.select(F.col("node").alias("low"), F.col("dominator").alias("node")), "node").select(F.col("low").alias("node"), "dominator")
        new = materialize(pairs.unionByName(more).distinct(), "pairs")
        up = materialize(up.join(up.select(F.col("node").alias("dominator"), F.col("dominator").alias("far")), "dominator").select("node", F.col("far").alias("dominator")), "up")
        pairs = new
    own = idom.select("node", F.col("node").alias("dominator"))
    return (pairs if strict else pairs.unionByName(own)).select("dominator", "node")


def dominates(idom: DataFrame, dominator: int, node: int) -> bool:
    """Whether every way from the root to ``node`` passes ``dominator``; a node dominates itself, if it is reached."""
    return dominator in dominator_chain(idom, node)


def dominated_by(idom: DataFrame, node: int) -> DataFrame:
    """The nodes whose immediate dominator is ``node``."""
    return idom.where(F.col("idom") == node).select("node").orderBy("node")


def dominance_frontiers(t: Topology, root: int, keep=None) -> DataFrame:
    """(node, frontier): one row for each node in a frontier."""

    def kernel(g: Small):
        r = _place(g, root)
        return [] if r is None else [(g.names[u], g.names[v]) for u, f in sorted(walk.dominance_frontiers(g, r).items()) for v in f]

    return run(_reached(_kept(t, keep), root), kernel, "node long, frontier long")


def feedback_arc_set(t: Topology) -> DataFrame:
    """(edge) of a set whose removal leaves no cycle; loops are in it. Edges between strong components never are."""
    scc = materialize(strongly_connected(t), "scc")
    inner = t.edges.join(scc.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst").where("c = d").select("edge", "src", "dst")
    return run(Topology(t.vertices, inner), lambda g: [(e,) for e in walk.feedback_arcs(g)], "edge long", by=scc)


# Connectivity ----------------------------------------------------------------------------------------------------


def bridges(t: Topology) -> DataFrame:
    return by_component(t, lambda g: [(g.ids[k],) for k in cuts.lowlinks(g)[0]], "edge long")


def articulation_points(t: Topology) -> DataFrame:
    return by_component(t, lambda g: [(g.names[u],) for u in cuts.lowlinks(g)[1]], "node long")


def biconnected_components(t: Topology, keep=None) -> DataFrame:
    """(block, edge): a block is named by its smallest edge; a loop is a block of its own."""
    return by_component(_kept(t, keep), lambda g: [(g.ids[b[0]], g.ids[k]) for b in cuts.lowlinks(g)[2] for k in b], "block long, edge long")


def chain_decomposition(t: Topology, source: int | None = None, keep=None) -> DataFrame | None:
    """(component, chain, step, edge, src, dst); from one source, or of every component; None if the source isn't a vertex."""
    g = _kept(t, keep)
    if source is not None:
        if t.vertices.where(F.col("node") == source).isEmpty():
            return None
        g = _reached(g, source, "both")

    def kernel(s: Small):
        found = cuts.chains(s, None if source is None else _place(s, source))
        return [(s.names[0], c, k, s.ids[e], s.names[u], s.names[v]) for c, chain in enumerate(found) for k, (e, u, v) in enumerate(chain)]

    return by_component(g, kernel, "component long, chain long, step long, edge long, src long, dst long")


def stoer_wagner(t: Topology, weight: str = "1", keep=None) -> tuple[float, list[int]] | None:
    """(weight, smaller side) of a least cut; 0 at once for several components; None below two nodes."""
    from lodestone.operators.components import weakly_connected

    g = _kept(t, keep)
    if t.node_count() < 2:
        return None
    comp = materialize(weakly_connected(g), "components")
    sizes = comp.groupBy("component").count().orderBy("count", "component").limit(2).collect()
    if len(sizes) > 1:
        return 0, [r[0] for r in comp.where(F.col("component") == sizes[0][0]).orderBy("node").select("node").collect()]
    row = run(g, lambda s: [(str(c[0]), [s.names[u] for u in c[1]])] if (c := cuts.stoer_wagner(s, s.data["w"])) else [], "weight string, side array<long>", {"w": (weight, float)}).first()
    return (float(row[0]), list(row[1]))


def steiner_tree(t: Topology, terminals: list[int], weight: str = "1") -> tuple[int, list[int]] | None:
    """(cost, edges) of an approximately least tree that joins the terminals; None if it can't."""
    want = sorted(set(terminals))
    if t.vertices.where(F.col("node").isin(want)).count() < len(want):
        return None
    if len(want) < 2:
        return 0, []
    row = run(t, lambda g: [(str(c[0]), [g.ids[k] for k in c[1]])] if (c := cuts.steiner(g, g.data["w"], [_place(g, x) for x in want])) else [], "cost string, edges array<long>", {"w": (weight, int)}).first()
    return None if row is None else (int(row[0]), list(row[1]))


# Matching, cliques, colours, communities -------------------------------------------------------------------------


def maximum_bipartite_matching(t: Topology) -> DataFrame | None:
    """(left, right); None if the graph isn't bipartite."""
    side = bipartite_partition(t)
    if side is None:
        return None
    side = materialize(side, "side")
    rich = t.edges.join(side.select(F.col("node").alias("src"), F.col("side").alias("s")), "src")

    def kernel(g: Small):
        half = [0] * g.n
        for (u, v), s in zip(g.edges, g.data["s"], strict=True):
            half[u], half[v] = s, 1 - s
        return [(g.names[u], g.names[v]) for u, v in cuts.hopcroft_karp(g, half)]

    return by_component(Topology(t.vertices, rich, t.directed), kernel, "left long, right long", {"s": ("s", int)})


def maximum_matching(t: Topology) -> DataFrame:
    """(left, right), left < right."""
    return by_component(t, lambda g: [(g.names[u], g.names[v]) for u, v in cuts.maximum_matching(g)], "left long, right long")


def maximal_cliques(t: Topology, limit: int | None = None) -> tuple[DataFrame, bool] | DataFrame:
    """(clique array); with ``limit`` at most that many, in order, and whether there are more."""
    out = by_component(t, lambda g: [([g.names[u] for u in c],) for c in cuts.maximal_cliques(g, limit)], "clique array<long>")
    if limit is None:
        return out
    out = materialize(out.orderBy("clique").limit(limit + 1), "cliques")
    return out.orderBy("clique").limit(limit), out.count() > limit


def dsatur(t: Topology) -> DataFrame | None:
    """(node, colour); None where an edge is a loop."""
    if not t.edges.where("src = dst").isEmpty():
        return None
    return by_component(t, lambda g: [(g.names[u], c) for u, c in enumerate(cuts.dsatur(g))], "node long, colour int")


def label_propagation(t: Topology, rounds: int = 100) -> DataFrame:
    """(node, community), named by the community's smallest node. Labels never leave a component."""

    def kernel(g: Small):
        label = walk.label_propagation(g, rounds)
        low: dict[int, int] = {}
        for u, x in enumerate(label):
            low.setdefault(x, g.names[u])
        return [(g.names[u], low[x]) for u, x in enumerate(label)]

    return by_component(t, kernel, "node long, community long")


def cycle_basis(t: Topology) -> DataFrame:
    """(cycle): sorted nodes of one cycle per edge outside a breadth-first forest."""
    return by_component(t, lambda g: [([g.names[u] for u in c],) for c in cuts.cycle_basis(g)], "cycle array<long>")


# Enumeration -----------------------------------------------------------------------------------------------------


def elementary_circuits(t: Topology, limit: int) -> tuple[list[list[int]], bool]:
    """(closed circuits, whether there are more); only inside strong components, where circuits live."""
    scc = materialize(strongly_connected(t), "scc")
    inner = t.edges.join(scc.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst").where("c = d").select("edge", "src", "dst")
    rows = run(Topology(t.vertices, inner), lambda g: [([g.names[u] for u in c],) for c in listing.circuits(g, limit + 1)[0]], "circuit array<long>", by=scc)
    got = [list(r[0]) for r in rows.orderBy("circuit").limit(limit + 1).collect()]
    return got[:limit], len(got) > limit


def all_simple_paths(t: Topology, source: int, target: int, max_depth: int, max_paths: int) -> tuple[list[list[int]], bool]:
    def kernel(g: Small):
        s, e = _place(g, source), _place(g, target)
        return [] if s is None or e is None else [([g.names[u] for u in p],) for p in listing.simple_paths(g, s, e, max_depth, max_paths + 1)[0]]

    got = [list(r[0]) for r in run(_between(t, source, target), kernel, "path array<long>").orderBy("path").collect()]
    return got[:max_paths], len(got) > max_paths


def k_shortest_paths(t: Topology, source: int, target: int, k: int, weight: str) -> list[tuple[list[int], int]]:
    def kernel(g: Small):
        s, e = _place(g, source), _place(g, target)
        return [] if s is None or e is None else [(i, [g.names[u] for u in p], str(c)) for i, (p, c) in enumerate(listing.k_shortest(g, s, e, k, g.data["w"]))]

    rows = run(_between(t, source, target), kernel, "place long, path array<long>, cost string", {"w": (weight, int)}).orderBy("place").collect()
    return [(list(r[1]), int(r[2])) for r in rows]


# Flow ------------------------------------------------------------------------------------------------------------


def maximum_flow(t: Topology, source: int, sink: int, capacity: str, method: str = "dinic") -> tuple[int, DataFrame, list[int]] | None:
    """(value, (edge, flow) of every edge, nodes on the source's side of a least cut); None if an endpoint is missing.

    Only nodes on some way from source to sink carry flow, so only those reach the kernel; ``method`` names are the same flow.
    """
    if t.vertices.where(F.col("node").isin([source, sink])).count() < len({source, sink}):
        return None
    part = _between(t, source, sink) if source != sink else t.induced(t.vertices.where(F.col("node") == source))

    def kernel(g: Small):
        s, e = _place(g, source), _place(g, sink)
        if s is None or e is None:
            return []
        value, flows, side = flow.maximum_flow(g, s, e, g.data["c"])
        return [(str(value), None, [g.names[u] for u in side]), *((str(f), g.ids[k], None) for k, f in enumerate(flows))]

    rows = materialize(run(part, kernel, "amount string, edge long, side array<long>", {"c": (capacity, int)}), "flow")
    head = rows.where("edge is null").first()
    value, side = (int(head[0]), set(head[2])) if head else (0, {source})
    flows = t.edges.select("edge").join(rows.where("edge is not null").select("edge", F.col("amount").cast("decimal(38,0)").alias("flow")), "edge", "left").select("edge", F.coalesce("flow", F.lit(0)).alias("flow"))
    # nodes reached in the residual graph but on no way to the sink are on the source's side as well
    net = t.edges.join(flows, "edge").withColumn("room", F.expr(capacity).cast("decimal(38,0)") - F.col("flow"))
    arcs = net.where("room > 0").select("edge", "src", "dst").unionByName(net.where("flow > 0").select("edge", F.col("dst").alias("src"), F.col("src").alias("dst")))
    side = sorted(r[0] for r in bfs(Topology(t.vertices, materialize(arcs, "residual")), source).select("node").collect()) if source != sink else [source]
    return value, flows, side


def edmonds_karp(t: Topology, source: int, sink: int, capacity: str):
    return maximum_flow(t, source, sink, capacity, "edmonds_karp")


def push_relabel(t: Topology, source: int, sink: int, capacity: str):
    return maximum_flow(t, source, sink, capacity, "push_relabel")


def min_cost_max_flow(t: Topology, source: int, sink: int, capacity: str, cost: str) -> tuple[int, int, DataFrame] | None:
    """(value, cost, (edge, flow)); a negative cycle with room is an error; None if an endpoint is missing."""
    if t.vertices.where(F.col("node").isin([source, sink])).count() < len({source, sink}):
        return None

    def kernel(g: Small):
        s, e = _place(g, source), _place(g, sink)
        value, price, flows = flow.minimum_cost_flow(g, s, e, g.data["c"], g.data["p"])
        return [(str(value), str(price), None), *((str(f), None, g.ids[k]) for k, f in enumerate(flows))]

    rows = materialize(run(t, kernel, "amount string, price string, edge long", {"c": (capacity, int), "p": (cost, int)}), "flow")
    head = rows.where("edge is null").first()
    return int(head[0]), int(head[1]), rows.where("edge is not null").select("edge", F.col("amount").cast("decimal(38,0)").alias("flow"))
