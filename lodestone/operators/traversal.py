"""Breadth-first traversal, reachability and unweighted paths, as joins of frontiers with edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.plans.loop import number_rows
from lodestone.scratch import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bfs(t: Topology, start: int, direction: str = "outgoing", keep: Column | str | None = None, max_depth: int | None = None, limit: int | None = None, target: int | None = None) -> DataFrame:
    """(node, position, level, parent, via): discovery order from ``start``; empty if it isn't a vertex.

    Order is that of a queue: by the discoverer's position, outgoing edges before incoming ones, then edge index.
    ``limit`` and ``target`` stop the loop early.
    """
    arcs = (t.filter_edges(keep) if keep is not None else t).arcs(direction)
    first = t.vertices.where(F.col("node") == start).select("node", F.lit(0).cast("long").alias("position"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("via"))
    levels = [materialize(first, "bfs")]
    found, depth = levels[0].count(), 0
    if not found or target == start:
        return levels[0]
    while (max_depth is None or depth < max_depth) and (limit is None or found < limit):
        depth += 1
        step = arcs.join(levels[-1].select(F.col("node").alias("a"), "position"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("position", "flag", "edge", "a")).alias("by"))
        new = step.join(_union(levels).select("node"), "node", "left_anti").select("node", F.lit(depth).alias("level"), F.col("by.a").alias("parent"), F.col("by.edge").alias("via"), "by")
        new = number_rows(new, ["by.position", "by.flag", "by.edge"], "position", found).select("node", "position", "level", "parent", "via")
        n = new.count()
        if not n:
            break
        found += n
        levels.append(new)
        if len(levels) > 12:  # one table for what is behind the frontier
            levels = [materialize(_union(levels[:-1]), "bfs"), levels[-1]]
        if target is not None and not new.where(F.col("node") == target).isEmpty():
            break
    out = _union(levels)
    return out if limit is None else out.where(F.col("position") < limit)


def reachable(t: Topology, start: int, target: int, direction: str = "outgoing", keep: Column | str | None = None) -> bool:
    return not bfs(t, start, direction, keep, target=target).where(F.col("node") == target).isEmpty()


def follow(pointers: DataFrame, target: int) -> list[int]:
    """The chain target, parent, ... reversed, of (node, parent): by pointer doubling, so a path takes log rounds."""
    spark = pointers.sparkSession
    jump = materialize(pointers.where("parent is not null").select("node", "parent"), "jump")
    chain = spark.createDataFrame([(target, 0)], "node long, at long")
    step = 1
    while True:
        more = chain.join(jump, "node").select(F.col("parent").alias("node"), (F.col("at") + step).alias("at"))
        chain_ = materialize(chain.unionByName(more), "chain")
        if chain_.count() == chain.count():
            break
        chain = chain_
        jump = materialize(jump.join(jump.select(F.col("node").alias("parent"), F.col("parent").alias("up")), "parent").select("node", F.col("up").alias("parent")), "jump")
        step *= 2
    return [r[0] for r in chain.orderBy(F.desc("at")).collect()]


def shortest_path(t: Topology, start: int, target: int, direction: str = "outgoing", keep: Column | str | None = None) -> list[int] | None:
    """A path of fewest edges; of several that whose nodes were discovered first. None if there is none."""
    found = bfs(t, start, direction, keep, target=target)
    if found.where(F.col("node") == target).isEmpty():
        return None
    return follow(found, target)


def distances(t: Topology, sources: DataFrame | None = None, direction: str = "outgoing", keep: Column | str | None = None) -> DataFrame:
    """(source, node, level, paths): for all sources at once, levels and the number of shortest paths (parallel edges count)."""
    arcs = materialize((t.filter_edges(keep) if keep is not None else t).arcs(direction).groupBy("a", "b").agg(F.count("*").alias("m")), "arcs")
    s = (t.vertices if sources is None else sources.select("node").distinct()).select(F.col("node").alias("source"), "node")
    levels = [materialize(s.select("source", "node", F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "levels")]
    depth = 0
    while True:
        depth += 1
        step = levels[-1].withColumnRenamed("node", "a").join(arcs, "a").groupBy("source", F.col("b").alias("node")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        new = materialize(step.join(_union(levels).select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("level"), "paths"), "levels")
        if new.isEmpty():
            return _union(levels)
        levels.append(new)
        if len(levels) > 12:
            levels = [materialize(_union(levels[:-1]), "levels"), levels[-1]]


def bfs_batch(t: Topology, starts: list[int]) -> DataFrame:
    """(query, node, level) for each of ``starts``, in their order; one loop serves them all."""
    q = t.spark.createDataFrame(list(enumerate(starts)), "query long, source long")
    d = distances(t, q.select(F.col("source").alias("node")).join(t.vertices, "node", "left_semi"))
    return q.join(d, "source").select("query", "node", "level")
