"""Minimum spanning forests by Boruvka rounds, bipartition, and subgraph patterns by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.operators.contract import connected_components
from lodestone.scratch import drop, materialize


def minimum_spanning_forest(t: Topology, weight: Column | str) -> DataFrame:
    """(edge, src, dst, weight) of the forest: the same edges as Kruskal's, as (weight, edge) is a strict order."""
    w = F.expr(weight) if isinstance(weight, str) else weight
    e = materialize(t.edges.where("src <> dst").select("edge", "src", "dst", w.alias("w")), "edges")
    live = materialize(e.select("edge", F.col("src").alias("s"), F.col("dst").alias("d"), "w"), "live")
    chosen = materialize(e.select("edge", "src", "dst").limit(0), "chosen")
    while not live.isEmpty():
        ends = live.select(F.col("s").alias("c"), "w", "edge", "s", "d").unionByName(live.select(F.col("d").alias("c"), "w", "edge", "s", "d"))
        pick = materialize(ends.groupBy("c").agg(F.min(F.struct("w", "edge", "s", "d")).alias("b")).select("b.edge", F.col("b.s").alias("src"), F.col("b.d").alias("dst")).distinct(), "pick")
        chosen_ = materialize(chosen.unionByName(pick), "chosen")
        comp = materialize(connected_components(pick), "comp")
        # Links of both ends' components; what is inside one is done.
        nxt = live.join(comp.select(F.col("node").alias("s"), F.col("component").alias("cs")), "s", "left").join(comp.select(F.col("node").alias("d"), F.col("component").alias("cd")), "d", "left")
        nxt = materialize(nxt.select("edge", F.coalesce("cs", "s").alias("s"), F.coalesce("cd", "d").alias("d"), "w").where("s <> d"), "live")
        drop(live)
        live, chosen = nxt, chosen_
    return e.join(chosen.select("edge").distinct(), "edge", "left_semi").select("edge", "src", "dst", F.col("w").alias("weight"))


prim_spanning_forest = minimum_spanning_forest


def forest_summary(t: Topology, weight: Column | str) -> DataFrame:
    """(total_weight decimal, edges, components): isolated nodes are components."""
    f = materialize(minimum_spanning_forest(t, weight), "forest")
    return f.agg(F.coalesce(F.sum(F.col("weight").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total_weight"), F.count("*").alias("edges")).withColumn("components", F.lit(t.node_count()) - F.col("edges"))


def bipartite_partition(t: Topology) -> DataFrame | None:
    """(node, side), side 0 for the smallest node of each component; None for an odd cycle or a loop.

    Components are taken of the double cover, nodes (v, 0) and (v, 1): a graph is bipartite if no v meets itself there.
    """
    if not t.edges.where("src = dst").isEmpty():
        return None
    e = t.edges.select("src", "dst").distinct()
    cover = e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst")).unionByName(e.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2).alias("dst")))
    c = materialize(connected_components(cover), "cover").select(F.shiftright("node", 1).alias("node"), (F.col("node") % 2).alias("half"), "component")
    two = c.groupBy("node").agg(F.min(F.when(F.col("half") == 0, F.col("component"))).alias("c0"), F.min(F.when(F.col("half") == 1, F.col("component"))).alias("c1"))
    if not two.where("c0 = c1").isEmpty():
        return None
    # (r, 0) of a component's smallest node r is the smaller of its two halves
    return t.vertices.join(two, "node", "left").select("node", F.when(F.col("c0") < F.col("c1"), 0).when(F.col("c0").isNull(), 0).otherwise(1).alias("side"))


def subgraph_isomorphisms(pattern: list[tuple[int, int]], pattern_nodes: int, t: Topology, induced: bool = True, limit: int | None = None, node_match: Column | None = None, edge_match: Column | None = None) -> DataFrame:
    """Mappings p0, p1, ... (pattern node -> target node), by one join per pattern edge.

    Pattern nodes are bound in an order that keeps the joins connected where it can; mappings are injective; each
    pattern edge needs as many parallel target edges as the pattern has between its nodes. ``induced`` also forbids target
    edges between mapped nodes where the pattern has none (counts must be equal). ``node_match`` is a condition on
    ``node`` and ``pattern_node``, ``edge_match`` one on the target's edge columns.
    """
    counts: dict[tuple[int, int], int] = {}
    for a, b in pattern:
        counts[a, b] = counts.get((a, b), 0) + 1
    degree = [sum(x == k for e in pattern for x in e) for k in range(pattern_nodes)]
    order: list[int] = []
    while len(order) < pattern_nodes:
        rest = [k for k in range(pattern_nodes) if k not in order]
        order.append(max(rest, key=lambda k: (any((k in e) and (set(e) - {k}) & set(order) for e in counts), degree[k], -k)))
    e = t.edges.where(edge_match) if edge_match is not None else t.edges
    pairs = materialize(e.groupBy("src", "dst").agg(F.count("*").alias("m")), "pairs")
    every = materialize(t.edges.groupBy("src", "dst").agg(F.count("*").alias("m")), "pairs") if edge_match is not None else pairs

    def nodes(k):
        v = t.vertices.select("node").withColumn("pattern_node", F.lit(k))
        return (v.where(node_match) if node_match is not None else v).select(F.col("node").alias(f"p{k}"))

    out = None
    bound: list[int] = []
    for k in order:
        touching = [(a, b) for a, b in counts if k in (a, b) and ({a, b} - {k} or {k}) <= set(bound) | {k}]
        links = [(a, b) for a, b in touching if a != b and (a in bound or b in bound)]
        if out is None:
            out = nodes(k)
        elif links:
            a, b = links[0]
            step = pairs.where(F.col("m") >= counts[a, b]).select(F.col("src").alias(f"p{a}"), F.col("dst").alias(f"p{b}"))
            out = out.join(step, f"p{a if a in bound else b}").join(nodes(k), f"p{k}", "left_semi")
            links = links[1:]
        else:
            out = out.crossJoin(nodes(k))
        for j in bound:
            out = out.where(F.col(f"p{k}") != F.col(f"p{j}"))
        for a, b in links + [x for x in touching if x[0] == x[1]]:
            need = pairs.where(F.col("m") >= counts[a, b])
            out = out.join(need.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), (F.col(f"p{a}") == F.col("_s")) & (F.col(f"p{b}") == F.col("_d")), "left_semi")
        bound.append(k)
        if induced:
            for j in bound:
                for a, b in {(k, j), (j, k)}:
                    need = counts.get((a, b), 0)
                    out = out.join(every.where(F.col("m") > need).select(F.col("src").alias("_s"), F.col("dst").alias("_d")), (F.col(f"p{a}") == F.col("_s")) & (F.col(f"p{b}") == F.col("_d")), "left_anti")
    names = [f"p{k}" for k in range(pattern_nodes)]
    out = out.select(*names)
    return out.orderBy(*names).limit(limit) if limit is not None else out


def isomorphism_search(pattern: list[tuple[int, int]], pattern_nodes: int, t: Topology, limit: int, induced: bool = True, node_match: Column | None = None, edge_match: Column | None = None) -> tuple[DataFrame, bool]:
    """(the first ``limit`` mappings in order, whether there are more)."""
    found = materialize(subgraph_isomorphisms(pattern, pattern_nodes, t, induced, limit + 1, node_match, edge_match), "mappings")
    names = [f"p{k}" for k in range(pattern_nodes)]
    return found.orderBy(*names).limit(limit), found.count() > limit


def graph_isomorphic(left: Topology, right: Topology) -> bool:
    """Equal counts and degree sequences, then an exact search on the smaller side's edges."""
    if (left.node_count(), left.edge_count()) != (right.node_count(), right.edge_count()):
        return False

    def profile(t):
        d = t.degrees("outgoing").withColumnRenamed("degree", "o").join(t.degrees("incoming").withColumnRenamed("degree", "i"), "node")
        return {(r["o"], r["i"]): r["n"] for r in d.groupBy("o", "i").agg(F.count("*").alias("n")).collect()}

    if profile(left) != profile(right):
        return False
    from lodestone.kernels.run import pair_kernel

    return pair_kernel(left, right)
