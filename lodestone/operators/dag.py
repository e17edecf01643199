"""Topological order, longest paths, closure and reduction.

Large graphs are peeled generation by generation, in joins. Peeling takes a round per generation, so graphs of at most
``KERNEL_EDGES`` edges (counted first) are ordered in one task instead; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.graph import Topology
from lodestone.operators.traversal import _union, follow
from lodestone.plans.loop import number_rows
from lodestone.scratch import drop, materialize


KERNEL_EDGES = 1_000_000


def _small(t: Topology) -> bool:
    return t.edges.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES


def _queue(g) -> list[int]:
    """Nodes as a first-in-first-out queue releases them; fewer than all for a cyclic graph."""
    adj, open_ = g.out(), [0] * g.n
    for _, v in g.edges:
        open_[v] += 1
    order = [u for u in range(g.n) if not open_[u]]
    for u in order:
        for v, _ in adj[u]:
            open_[v] -= 1
            if not open_[v]:
                order.append(v)
    return order


def _order_kernel(g) -> list[tuple]:
    order, adj = _queue(g), g.out()
    if len(order) < g.n:
        return []
    level = [0] * g.n
    for u in order:
        for v, _ in adj[u]:
            level[v] = max(level[v], level[u] + 1)
    return [(g.names[u], k, level[u]) for k, u in enumerate(order)]


def _longest_kernel(g) -> list[tuple]:
    order, adj, w = _queue(g), g.out(), g.data["w"]
    if len(order) < g.n:
        return [(None, None, None, None, None)]
    cost, by = [0] * g.n, [None] * g.n
    for u in order:
        for v, k in adj[u]:
            if w[k] is not None and cost[u] + w[k] > cost[v]:
                cost[v], by[v] = cost[u] + w[k], k
                if cost[v] != cost[v] or cost[v] in (float("inf"), float("-inf")):
                    raise errors.ArithmeticOverflow("longest path")
    return [(g.names[u], str(cost[u]), None if by[u] is None else g.names[g.edges[by[u]][0]], None if by[u] is None else g.ids[by[u]], p) for p, u in enumerate(order)]


def topological(t: Topology, keep=None) -> DataFrame | None:
    """(node, position, generation), or None for a cyclic graph.

    The order is that of a first-in-first-out queue of nodes without open predecessors: inside a generation by the last
    predecessor's position, then by its edge's index; the first generation by node.
    """
    g = t.filter_edges(keep) if keep is not None else t
    if _small(g):
        from lodestone.kernels.run import run

        out = materialize(run(g, _order_kernel, "node long, position long, generation int"), "order")
        return None if out.isEmpty() and not t.vertices.isEmpty() else out
    e = materialize(g.edges.select("edge", "src", "dst"), "edges")
    left = materialize(t.vertices.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open")), "node", "left").select("node", F.coalesce("open", F.lit(0).cast("long")).alias("open"), F.lit(None).cast("struct<position:bigint,edge:bigint>").alias("by")), "open")
    total, found, generation, parts = left.count(), 0, 0, []
    while True:
        free = left.where("open = 0")
        order = ["node"] if generation == 0 else ["by.position", "by.edge"]
        now = number_rows(free.select("node", "by"), order, "position", found).select("node", "position", F.lit(generation).alias("generation"))
        n = now.count()
        if not n:
            break
        found += n
        parts.append(now)
        closed = e.join(now.select(F.col("node").alias("src"), "position"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("m"), F.max(F.struct("position", "edge")).alias("by2"))
        rest = materialize(left.where("open > 0").join(closed, "node", "left").select("node", (F.col("open") - F.coalesce("m", F.lit(0))).alias("open"), F.greatest("by", "by2").alias("by")), "open")
        drop(left)
        left, generation = rest, generation + 1
        if len(parts) > 12:
            parts = [materialize(_union(parts), "order")]
    if found < total:
        return None
    return _union(parts) if parts else t.vertices.select("node", F.lit(0).cast("long").alias("position"), F.lit(0).alias("generation")).limit(0)


def has_cycle(t: Topology, keep=None) -> bool:
    return topological(t, keep) is None


def cyclic_core(t: Topology, keep=None) -> Topology:
    """What is left when nodes without a way in or out are peeled off: every cycle is inside. Small graphs stay whole."""
    now = (t.filter_edges(keep) if keep is not None else t).edges.select("edge", "src", "dst")
    n = now.count()
    if n <= KERNEL_EDGES:
        return Topology(now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))).distinct(), now)
    while True:
        new = materialize(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("edge", "src", "dst"), "core")
        m = new.count()
        if m == n:
            return Topology(new.select(F.col("src").alias("node")).distinct(), new)
        now, n = new, m


def longest(t: Topology, weight: Column | str | None = None, keep=None) -> DataFrame:
    """(node, cost, parent, via, position): greatest cost of a path that ends at each node, every node starting at 0.

    A cyclic graph is an error. Of equal costs the predecessor earliest in topological order is kept.
    """
    g = t.filter_edges(keep) if keep is not None else t
    kind = g.edges.select((F.lit(1).cast("long") if weight is None else F.expr(weight) if isinstance(weight, str) else weight).alias("w")).schema["w"].dataType.simpleString()
    if isinstance(weight, (str, type(None))) and kind in ("int", "bigint", "double") and _small(g):
        from lodestone.kernels.run import run

        rows = run(g, _longest_kernel, "node long, cost string, parent long, via long, position long", {"w": (weight or "1", float if kind == "double" else int)})
        rows = materialize(rows, "longest")
        if not rows.where("node is null").isEmpty():
            raise errors.CyclicGraph("the longest path needs an acyclic graph")
        return rows.withColumn("cost", F.col("cost").cast(kind))
    order = topological(t, keep)
    if order is None:
        raise errors.CyclicGraph("the longest path needs an acyclic graph")
    order = materialize(order, "order")
    w = F.lit(1).cast("long") if weight is None else (F.expr(weight) if isinstance(weight, str) else weight)
    e = g.edges.select("edge", "src", "dst", w.alias("w")).where("w is not null")
    e = materialize(e.join(order.select(F.col("node").alias("src"), F.col("position").alias("p")), "src").join(order.select(F.col("node").alias("dst"), F.col("generation").alias("g")), "dst"), "edges")
    last = order.agg(F.max("generation")).first()[0]
    zero = F.lit(0).cast(kind)
    none = F.lit(None).cast("long")
    parts = [materialize(order.where("generation = 0").select("node", zero.alias("cost"), none.alias("parent"), none.alias("via"), "position"), "longest")]
    for g in range(1, (last or 0) + 1):
        step = e.where(F.col("g") == g).join(_union(parts).select(F.col("node").alias("src"), "cost"), "src").select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("c"), "p", "edge", "src")
        if kind == "double" and not step.where("c in (double('inf'), double('-inf')) or isnan(c)").isEmpty():
            raise errors.ArithmeticOverflow("longest path")
        best = step.where(F.col("c") > zero).groupBy("node").agg(F.max(F.struct("c", (-F.col("p")).alias("np"), (-F.col("edge")).alias("ne"), "src")).alias("b"))
        parts.append(materialize(order.where(F.col("generation") == g).join(best, "node", "left").select("node", F.coalesce("b.c", zero).alias("cost"), F.col("b.src").alias("parent"), (-F.col("b.ne")).alias("via"), "position"), "longest"))
        if len(parts) > 12:
            parts = [materialize(_union(parts), "longest")]
    return _union(parts)


def dag_longest_path(t: Topology, weight: Column | str | None = None, keep=None) -> tuple[list[int], object] | None:
    """(path, cost); None for an empty graph."""
    table = longest(t, weight, keep)
    end = table.orderBy(F.desc("cost"), "position").select("node", "cost").first()
    return None if end is None else (follow(table, end[0]), end[1])


def dag_longest_path_length(t: Topology, weight: Column | str | None = None, keep=None):
    return longest(t, weight, keep).agg(F.max("cost")).first()[0]


def transitive_closure(t: Topology, keep=None) -> DataFrame:
    """(src, dst) of every pair connected by a path of one edge or more, by doubling path lengths."""
    e = (t.filter_edges(keep) if keep is not None else t).edges.select("src", "dst").distinct()
    now = materialize(e, "closure")
    n = now.count()
    while True:
        step = now.alias("x").join(now.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")
        new = materialize(now.unionByName(step).distinct(), "closure")
        m = new.count()
        drop(now)
        now = new
        if m == n:
            return now
        n = m


def dag_reduction_closure(t: Topology, keep=None) -> tuple[DataFrame, DataFrame] | None:
    """(reduction, closure) as (src, dst) tables; None for a cyclic graph. Parallel edges count once."""
    if has_cycle(t, keep):
        return None
    closure = transitive_closure(t, keep)
    e = (t.filter_edges(keep) if keep is not None else t).edges.select("src", "dst").distinct()
    around = e.alias("x").join(closure.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")
    return e.join(around, ["src", "dst"], "left_anti"), closure
