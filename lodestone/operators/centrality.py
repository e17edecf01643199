"""Centralities that look from every node: closeness, betweenness, edge betweenness and distance measures.

Up to ``blocks.MOST_ARCS`` arcs (twice as many where sets of sources do), counted first, each task takes blocks of sources
over the shared arcs (``kernels.blocks``).
Beyond, all sources advance together, one join per level: the state is (source, node), dealt over all tasks, so nothing is
broadcast and no task holds a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.kernels import blocks
from lodestone.operators.rank import distinct_arcs
from lodestone.operators.traversal import _union
from lodestone.scratch import drop, materialize


def _reach(t: Topology, direction: str) -> DataFrame:
    """(node, r, total, far): the other nodes reached from each vertex, the sum of their levels and the largest."""
    from lodestone.operators.traversal import distances

    arcs = materialize(distinct_arcs(t, direction).select("a", "b", F.lit(1).cast("long").alias("x")), "arcs")
    n = blocks.net(t.vertices, arcs, 2 * blocks.MOST_ARCS)
    drop(arcs)
    if n is not None:
        return materialize(blocks.each_block(t.spark, n, blocks.reach, "node long, r long, total long, far int", 1 / 8, 64, state_bytes=blocks.SET_BYTES), "reach")
    return distances(t, None, direction).groupBy(F.col("source").alias("node")).agg((F.count("*") - 1).alias("r"), F.sum("level").alias("total"), F.max("level").alias("far"))


def closeness(t: Topology, direction: str = "outgoing") -> DataFrame:
    """(node, score): (r / total) * (r / (n - 1)) over the r other nodes reached; 0 where there are none."""
    n, d = t.node_count(), _reach(t, direction)
    score = F.when(F.col("r") > 0, F.col("r") / F.col("total") * (F.col("r") / F.lit(float(max(n - 1, 1))))).otherwise(0.0)
    return t.vertices.join(d.select("node", score.alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def _forward(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(source, node, level, paths) from every vertex; ``arcs`` (a, b, m)."""
    levels = [materialize(vertices.select(F.col("node").alias("source"), "node", F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "forward")]
    depth = 0
    while True:
        depth += 1
        step = levels[-1].withColumnRenamed("node", "a").join(arcs, "a").groupBy("source", F.col("b").alias("node")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        new = materialize(step.join(_union(levels).select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("level"), "paths"), "forward")
        if new.isEmpty():
            return materialize(_union(levels), "levels")
        levels.append(new)


def _dependencies(arcs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (source, node, delta) and, per step of a shortest path, (a, b, flow) summed over the sources."""
    deepest = found.agg(F.max("level")).first()[0] or 0
    delta = [materialize(found.where(F.col("level") == deepest).select("source", "node", F.lit(0.0).alias("delta")), "delta")]
    flows = []
    for level in range(deepest - 1, -1, -1):
        up = found.where(F.col("level") == level).select("source", F.col("node").alias("a"), F.col("paths").alias("pa"))
        down = found.where(F.col("level") == level + 1).join(delta[-1], ["source", "node"]).select("source", F.col("node").alias("b"), F.col("paths").alias("pb"), "delta")
        steps = materialize(up.join(arcs, "a").join(down, ["source", "b"]).select("source", "a", "b", "m", (F.col("pa") / F.col("pb") * (1 + F.col("delta"))).alias("flow")), "steps")
        flows.append(steps.groupBy("a", "b").agg(F.sum("flow").alias("flow")))
        got = steps.groupBy("source", F.col("a").alias("node")).agg(F.sum(F.col("flow") * F.col("m")).alias("d"))
        delta.append(materialize(found.where(F.col("level") == level).join(got, ["source", "node"], "left").select("source", "node", F.coalesce("d", F.lit(0.0)).alias("delta")), "delta"))
    empty = arcs.select("a", "b", F.lit(0.0).alias("flow")).limit(0)
    return _union(delta), (_union(flows).groupBy("a", "b").agg(F.sum("flow").alias("flow")) if flows else empty)


def betweenness(t: Topology, direction: str = "outgoing", normalised: bool = True) -> DataFrame:
    """(node, score) over distinct neighbours; with both directions each pair counts once."""
    n = t.node_count()
    both = direction == "both" or not t.directed
    arcs = materialize(distinct_arcs(t, direction).withColumn("m", F.lit(1)), "arcs")
    shared = blocks.net(t.vertices, arcs.select("a", "b", F.col("m").cast("long").alias("x")))
    if shared is not None:
        total = materialize(blocks.each_block(t.spark, shared, blocks.dependencies, "node long, s double", 32, 1, True).groupBy("node").agg(F.sum("s").alias("s")), "dependencies")
    else:
        d, _ = _dependencies(arcs, _forward(arcs, t.vertices))
        total = d.where("source <> node").groupBy("node").agg(F.sum("delta").alias("s"))
    scale = 0.5 if both else 1.0
    if normalised:
        scale *= (2.0 if both else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return t.vertices.join(total, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("score"))


def edge_betweenness(t: Topology, normalised: bool = False, keep=None) -> DataFrame:
    """(edge, score): parallel edges share, each by itself; loops get 0; undirected pairs count once."""
    g = t.filter_edges(keep) if keep is not None else t
    n = t.node_count()
    arcs = materialize(g.arcs("outgoing").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m")), "arcs")
    shared = blocks.net(t.vertices, arcs.select("a", "b", F.col("m").alias("x")))
    if shared is not None:
        flow = materialize(blocks.each_block(t.spark, shared, blocks.flows, "a long, b long, flow double", 32, 1, True).groupBy("a", "b").agg(F.sum("flow").alias("flow")), "flows")
    else:
        _, flow = _dependencies(arcs, _forward(arcs, t.vertices))
    e = g.edges.select("edge", "src", "dst")
    f = e.join(flow.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("flow").alias("x")), ["src", "dst"], "left")
    total = F.coalesce("x", F.lit(0.0))
    if not t.directed:
        f = f.join(flow.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("flow").alias("y")), ["src", "dst"], "left")
        total = total + F.coalesce("y", F.lit(0.0))
    scale = (1.0 / (n * (n - 1)) if n > 1 else 0.0) if normalised else 1.0 if t.directed else 0.5
    return f.select("edge", (F.when(F.col("src") == F.col("dst"), 0.0).otherwise(total) * scale).alias("score"))


def undirected_edge_betweenness(t: Topology, normalised: bool = False, keep=None) -> DataFrame:
    """``edge_betweenness`` of ``t`` without its edges' directions."""
    return edge_betweenness(t.undirected(), normalised, keep)


def distance_analytics(t: Topology, keep=None) -> DataFrame | None:
    """(node, eccentricity, diameter, radius, center, periphery) of an undirected connected graph; None otherwise."""
    g = (t.filter_edges(keep) if keep is not None else t).undirected()
    n = t.node_count()
    d = materialize(_reach(g, "both").select("node", F.col("far").alias("eccentricity"), (F.col("r") + 1).alias("r")), "distances")
    row = d.agg(F.max("eccentricity"), F.min("eccentricity"), F.min("r")).first()
    if not n or row[2] < n:
        return None
    return d.select("node", "eccentricity", F.lit(row[0]).alias("diameter"), F.lit(row[1]).alias("radius"), (F.col("eccentricity") == row[1]).alias("center"), (F.col("eccentricity") == row[0]).alias("periphery"))


def eccentricity(t: Topology, node: int) -> int | None:
    """Of one node of a connected graph; None otherwise."""
    d = distance_analytics(t)
    row = None if d is None else d.where(F.col("node") == node).first()
    return None if row is None else row["eccentricity"]


def _of_all(t: Topology, column: str) -> int | None:
    d = distance_analytics(t)
    return None if d is None else d.select(column).first()[0]


def diameter(t: Topology) -> int | None:
    return _of_all(t, "diameter")


def radius(t: Topology) -> int | None:
    return _of_all(t, "radius")


def _where(t: Topology, column: str) -> list[int] | None:
    d = distance_analytics(t)
    return None if d is None else [r[0] for r in d.where(column).orderBy("node").select("node").collect()]


def center(t: Topology) -> list[int] | None:
    return _where(t, "center")


def periphery(t: Topology) -> list[int] | None:
    return _where(t, "periphery")
