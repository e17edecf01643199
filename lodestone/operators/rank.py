"""PageRank, HITS, and degree, eigenvector and Katz centrality: joins and sums per iteration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.graph import Topology
from lodestone.scratch import drop, materialize


#: Rounds in one job where nothing has to be summed up between them.
CHAIN = 5


@dataclass(frozen=True)
class Iterated:
    """A table of scores, the iterations run and whether they converged."""

    scores: DataFrame
    iterations: int
    converged: bool


def _edges(t: Topology, keep) -> DataFrame:
    return (t.filter_edges(keep) if keep is not None else t).edges


def page_rank(t: Topology, damping: float = 0.85, iterations: int = 20, keep=None) -> DataFrame:
    """(node, score). Fixed iterations; dangling mass is shared by all; parallel edges weigh; normalised each time.

    Where every node has an edge out, the sum stays 1 but for rounding: ``CHAIN`` rounds then make one job, and each job's
    result is normalised."""
    if not 0.0 <= damping <= 1.0:
        raise errors.InvalidAlgorithmParameter(f"damping {damping}")
    e = _edges(t, keep).select("src", "dst")
    n = t.node_count()
    out = e.groupBy("src").agg(F.count("*").alias("degree"))
    # parallel edges become one row with their share of the source's rank
    share = materialize(e.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("share")), "share")
    base = materialize(t.vertices.select("node").join(out.select(F.col("src").alias("node"), F.lit(True).alias("out")), "node", "left").select("node", F.coalesce("out", F.lit(False)).alias("out")), "vertices")
    now, held = base.withColumn("score", F.lit(1.0 / max(n, 1))), None
    loose = now.agg(F.coalesce(F.sum(F.when(~F.col("out"), F.col("score"))), F.lit(0.0))).first()[0]
    chain = 1 if loose else CHAIN
    for k in range(1, iterations + 1):
        got = share.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        raw = base.join(got, "node", "left").select("node", "out", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * (F.coalesce("s", F.lit(0.0)) + F.lit(loose / max(n, 1)))).alias("score"))
        if k % chain and k < iterations:
            now = raw
            continue
        new = materialize(raw, "rank")
        # one pass over the new scores: their sum, to normalise by, and the dangling part for the next round
        total, rest = new.agg(F.coalesce(F.sum("score"), F.lit(1.0)), F.coalesce(F.sum(F.when(~F.col("out"), F.col("score"))), F.lit(0.0))).first()
        loose = rest / total
        if held is not None:
            drop(held)
        held, now = new, new.withColumn("score", F.col("score") / F.lit(total))
    if held is not None:
        drop(share)
        drop(base)
    return now.select("node", "score")


def hits(t: Topology, iterations: int = 100, tolerance: float = 1e-10, keep=None) -> Iterated:
    """Scores (node, hub, authority) over distinct pairs without loops; authorities first, then hubs from them, L2-normalised."""
    pairs = materialize(_edges(t, keep).where("src <> dst").select("src", "dst").distinct(), "pairs")
    n = t.node_count()
    if pairs.isEmpty():
        return Iterated(t.vertices.select("node", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority")), 0, True)
    start = 1.0 / n**0.5
    now = held = materialize(t.vertices.select("node", F.lit(start).alias("hub"), F.lit(start).alias("authority")), "hits")
    for k in range(1, iterations + 1):
        a = materialize(pairs.join(now.select(F.col("node").alias("src"), "hub"), "src").groupBy("dst").agg(F.sum("hub").alias("a")), "authority")
        an = (a.agg(F.sum(F.col("a") * F.col("a"))).first()[0] or 0.0) ** 0.5 or 1.0
        h = materialize(pairs.join(a, "dst").groupBy("src").agg((F.sum("a") / F.lit(an)).alias("h")), "hub")
        hn = (h.agg(F.sum(F.col("h") * F.col("h"))).first()[0] or 0.0) ** 0.5 or 1.0
        both = now.join(a.withColumnRenamed("dst", "node"), "node", "left").join(h.withColumnRenamed("src", "node"), "node", "left")
        new = materialize(both.select("node", (F.coalesce("h", F.lit(0.0)) / hn).alias("hub"), (F.coalesce("a", F.lit(0.0)) / an).alias("authority"), F.col("hub").alias("h0"), F.col("authority").alias("a0")), "hits")
        move = new.agg(F.max(F.greatest(F.abs(F.col("hub") - F.col("h0")), F.abs(F.col("authority") - F.col("a0"))))).first()[0] or 0.0
        for done in (a, h, held):
            drop(done)
        now, held = new.select("node", "hub", "authority"), new
        if move <= tolerance:
            return Iterated(now, k, True)
    return Iterated(now, iterations, False)


def distinct_arcs(t: Topology, direction: str, keep=None) -> DataFrame:
    """(a, b): neighbours without repeats and loops."""
    return (t.filter_edges(keep) if keep is not None else t).arcs(direction).where("a <> b").select("a", "b").distinct()


def degree_centrality(t: Topology, direction: str = "both") -> DataFrame:
    """(node, score): distinct neighbours over n - 1; 0 for a single node."""
    n = t.node_count()
    d = distinct_arcs(t, direction).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
    return t.vertices.join(d, "node", "left").select("node", (F.coalesce("d", F.lit(0)) / F.lit(float(max(n - 1, 1)))).alias("score"))


def _iterate(t: Topology, start: float, step, iterations: int, done) -> Iterated:
    arcs = materialize(distinct_arcs(t, "outgoing"), "arcs")
    now = held = materialize(t.vertices.select("node", F.lit(start).alias("score")), "scores")
    for k in range(1, iterations + 1):
        got = arcs.join(now.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum("score").alias("s"))
        stepped = step(now.join(got, "node", "left").select("node", F.col("score").alias("was"), F.coalesce("s", F.lit(0.0)).alias("s")))
        new = materialize(stepped, "scores")
        drop(stepped)
        drop(held)
        held = new
        if not new.where("isnan(score) or score in (double('inf'), double('-inf'))").isEmpty():
            raise errors.ArithmeticOverflow("centrality diverged")
        move = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        now = new.select("node", "score")
        if done(move):
            return Iterated(now, k, True)
    return Iterated(now, iterations, False)


def eigenvector_centrality(t: Topology, iterations: int = 100, tolerance: float = 1e-9) -> Iterated:
    """x becomes x + A'x, L2-normalised, until the L1 change is at most tolerance times n."""
    n = t.node_count()

    def step(df):
        raw = materialize(df.withColumn("raw", F.col("was") + F.col("s")), "raw")
        norm = (raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0] or 0.0) ** 0.5 or 1.0
        out = raw.select("node", "was", (F.col("raw") / norm).alias("score"))
        out._lodestone_path = raw._lodestone_path  # it goes with the table that it reads
        return out

    return _iterate(t, 1.0 / max(n, 1), step, iterations, lambda move: move <= tolerance * n)


def katz_centrality(t: Topology, alpha: float = 0.1, beta: float = 1.0, iterations: int = 100, tolerance: float = 1e-9) -> Iterated:
    """x becomes beta + alpha A'x from 1, not normalised; divergence is an error."""
    n = t.node_count()
    return _iterate(t, 1.0, lambda df: df.select("node", "was", (F.lit(beta) + F.lit(alpha) * F.col("s")).alias("score")), iterations, lambda move: move <= tolerance * n)
