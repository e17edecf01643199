"""Where sequential algorithms run: one Arrow group per component, or one for a set that was narrowed by joins before.

A group must fit in a task, so its edges are counted first, and more than ``MOST_EDGES`` is an error rather than a
lost executor. What has a distributed form (components, order, ranks, forests, distances) doesn't come here.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.graph import Topology
from lodestone.kernels.small import Small

MOST_EDGES = 20_000_000


def _rows(t: Topology, group: DataFrame | None, payload: dict[str, str]) -> DataFrame:
    """(group, node, edge, src, dst, payload): nodes with null edges, and edges."""
    kinds = {c: F.expr(x) for c, x in payload.items()}
    none = [F.lit(None).cast("string").alias(c) for c in kinds]
    edges = t.edges.select("edge", "src", "dst", *[x.cast("string").alias(c) for c, x in kinds.items()])
    if group is None:
        v = t.vertices.select(F.lit(0).cast("long").alias("group"), "node")
        e = edges.withColumn("group", F.lit(0).cast("long"))
    else:
        v = group.select(F.col("component").alias("group"), "node")
        e = edges.join(group.select(F.col("node").alias("src"), F.col("component").alias("group")), "src")
    null = F.lit(None).cast("long")
    return v.select("group", "node", null.alias("edge"), null.alias("src"), null.alias("dst"), *none).unionByName(e.select("group", null.alias("node"), "edge", "src", "dst", *kinds))


def _guard(t: Topology, group: DataFrame | None, most: int) -> None:
    if group is None:
        n = t.edges.limit(most + 1).count()
    else:
        n = t.edges.join(group.select(F.col("node").alias("src"), "component"), "src").groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if n > most:
        raise errors.IndexCapacityExceeded(f"a group of {n} edges is more than a sequential kernel takes ({most})")


def small_of(pdf: pd.DataFrame, payload: dict[str, Callable]) -> Small:
    names = sorted(int(x) for x in pdf["node"].dropna())
    place = {x: k for k, x in enumerate(names)}
    e = pdf[pdf["edge"].notna()].sort_values("edge")
    pairs = [(place[int(a)], place[int(b)]) for a, b in zip(e["src"], e["dst"], strict=True)]
    return Small(names, pairs, [int(x) for x in e["edge"]], {c: [None if x is None or x != x else f(x) for x in e[c]] for c, f in payload.items()})


def run(t: Topology, kernel: Callable[[Small], list[tuple]], schema: str, payload: dict[str, tuple[str, Callable]] | None = None, by: DataFrame | None = None, most: int = MOST_EDGES) -> DataFrame:
    """``kernel`` of every group of ``by`` (node, component), or of the whole topology, as rows of ``schema``.

    ``payload``: name -> (SQL expression on the edge, parser of its text).
    """
    payload = payload or {}
    _guard(t, by, most)
    names = [p.strip().rsplit(" ", 1)[0] if "<" not in p else p.strip().split(" ", 1)[0] for p in _columns(schema)]
    parse = {c: f for c, (_, f) in payload.items()}

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = kernel(small_of(pdf, parse))
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(names)})

    return _rows(t, by, {c: x for c, (x, _) in payload.items()}).groupBy("group").applyInPandas(task, schema)


def _columns(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def by_component(t: Topology, kernel, schema: str, payload=None, most: int = MOST_EDGES) -> DataFrame:
    """``run`` per weak component: for algorithms whose result is the union over components."""
    from lodestone.operators.components import weakly_connected
    from lodestone.scratch import materialize

    return run(t, kernel, schema, payload, materialize(weakly_connected(t), "components"), most)


def pair_kernel(left: Topology, right: Topology) -> bool:
    """Exact isomorphism of two topologies, in one group."""
    from lodestone.kernels.enumerate import isomorphic

    shift = 1 << 40
    both = Topology(left.vertices.select("node").unionByName(right.vertices.select((F.col("node") + shift).alias("node"))), left.edges.select("edge", "src", "dst").unionByName(right.edges.select((F.col("edge") + shift).alias("edge"), (F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"))))

    def kernel(g: Small):
        cut = sum(x < shift for x in g.names)
        le = [e for e in g.edges if e[0] < cut]
        return [(isomorphic(cut, le, [(u - cut, v - cut) for u, v in g.edges if u >= cut]),)]

    row = run(both, kernel, "same boolean").first()
    return True if row is None else row[0]
