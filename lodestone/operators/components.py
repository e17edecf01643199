"""Weak and strong components, condensation, and k-cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.operators.contract import connected_components
from lodestone.scratch import drop, materialize


def weakly_connected(t: Topology, keep=None) -> DataFrame:
    """(node, component) of every vertex; a component is named by its smallest node."""
    e = (t.filter_edges(keep) if keep is not None else t).edges
    c = connected_components(e)
    return t.vertices.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(arcs: DataFrame, label: DataFrame) -> DataFrame:
    """Largest label that reaches each node along ``arcs`` (a, b), to the fixpoint."""
    now = label
    while True:
        step = arcs.join(now.select(F.col("node").alias("a"), "color"), "a").groupBy(F.col("b").alias("node")).agg(F.max("color").alias("c"))
        new = materialize(now.join(step, "node", "left").select("node", F.greatest("color", "c").alias("color"), (F.col("c") > F.col("color")).alias("moved")), "color")
        drop(now)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
        now._lodestone_path = new._lodestone_path


def strongly_connected(t: Topology, keep=None) -> DataFrame:
    """(node, component), named by the smallest node. Nodes without a way in or out are trimmed first; then the largest
    label spreads forwards, and what reaches a label's owner backwards inside its colour is its component."""
    arcs = materialize((t.filter_edges(keep) if keep is not None else t).edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "arcs")
    left = materialize(t.vertices.select("node"), "left")
    done: list[DataFrame] = []
    while True:
        # trim: each node without an incoming or outgoing arc is a component of its own
        core = arcs.select(F.col("a").alias("node")).intersect(arcs.select(F.col("b").alias("node")))
        core = materialize(core, "core")
        single = left.join(core, "node", "left_anti")
        done.append(materialize(single.select("node", F.col("node").alias("component")), "scc"))
        if core.isEmpty():
            break
        before = arcs.count()
        inner = materialize(arcs.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"), "arcs")
        drop(arcs)
        arcs, left = inner, core
        if arcs.count() < before:
            continue
        color = _spread(arcs, left.select("node", F.col("node").alias("color")))
        same = arcs.join(color.withColumnRenamed("node", "a").withColumnRenamed("color", "ca"), "a").join(color.withColumnRenamed("node", "b").withColumnRenamed("color", "cb"), "b").where("ca = cb")
        back = materialize(same.select(F.col("b").alias("a"), F.col("a").alias("b")), "back")
        owner = color.select("node", F.when(F.col("node") == F.col("color"), F.col("color")).otherwise(F.lit(-1)).alias("color"))
        owned = _spread(back, owner).where("color >= 0")
        found = materialize(owned.join(owned.groupBy("color").agg(F.min("node").alias("component")), "color").select("node", "component"), "scc")
        done.append(found)
        left = materialize(left.join(found, "node", "left_anti"), "left")
        rest = materialize(arcs.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "arcs")
        arcs = rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def condensation(t: Topology, keep=None) -> tuple[DataFrame, Topology]:
    """(members node -> component, the topology between components without repeats and loops)."""
    scc = materialize(strongly_connected(t, keep), "scc")
    e = (t.filter_edges(keep) if keep is not None else t).edges
    c = e.join(scc.select(F.col("node").alias("src"), F.col("component").alias("s")), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    from lodestone.plans.loop import number_rows

    return scc, Topology(scc.select(F.col("component").alias("node")).distinct(), number_rows(c, ["src", "dst"], "edge"))


def component_of(members: DataFrame, node: int) -> int | None:
    """The component of ``node`` in a table (node, component), or None."""
    row = members.where(F.col("node") == node).select("component").first()
    return None if row is None else row[0]


def simple_pairs(t: Topology) -> DataFrame:
    """(a, b), both ways, of the undirected simple projection: no loops, no repeats."""
    e = t.edges.where("src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def k_core(t: Topology) -> DataFrame:
    """(node, core): the h-index of the neighbours' values, iterated from the degrees until nothing changes."""
    pairs = materialize(simple_pairs(t), "pairs")
    now = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")), "core")
    while True:
        near = pairs.join(now.select(F.col("node").alias("b"), F.col("core").alias("c")), "b")
        # values are small integers: per node the counts of each value, not the list of neighbours, are gathered
        h = near.groupBy("a", "c").agg(F.count("*").alias("m")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("c", "m")), False).alias("v"))
        acc = F.aggregate("v", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("h")), lambda s, x: F.struct((s.seen + x.m).alias("seen"), F.greatest(s.h, F.least(x.c, s.seen + x.m)).alias("h")))
        new = materialize(h.select(F.col("a").alias("node"), acc.h.alias("h")).join(now, "node").select("node", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("moved")), "core")
        drop(now)
        now = new.select("node", "core")
        if new.where("moved").isEmpty():
            return t.vertices.join(now, "node", "left").select("node", F.coalesce("core", F.lit(0).cast("long")).alias("core"))
