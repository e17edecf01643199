"""Deterministic and seeded random topologies, as lazy ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import IndexCapacityExceeded, InvalidProbability
from lodestone.graph import U32, Topology


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    if n > U32:
        raise IndexCapacityExceeded(f"{n} nodes exceed the index capacity")
    return spark.range(n).select(F.col("id").alias("node"))


def path(spark: SparkSession, n: int) -> Topology:
    return Topology(_vertices(spark, n), spark.range(max(n - 1, 0)).select(F.col("id").alias("edge"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark: SparkSession, n: int) -> Topology:
    return Topology(_vertices(spark, n), spark.range(n).select(F.col("id").alias("edge"), F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(max(n, 1))).alias("dst")))


def _pairs(spark: SparkSession, count: int, src, dst) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("edge"), src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def complete(spark: SparkSession, n: int) -> Topology:
    """All ordered pairs of different nodes, by source."""
    i, m = F.col("id"), max(n - 1, 1)
    s, r = F.expr(f"id div {m}"), i % m
    return Topology(_vertices(spark, n), _pairs(spark, n * (n - 1) if n > 1 else 0, s, F.when(r < s, r).otherwise(r + 1)))


def star(spark: SparkSession, n: int) -> Topology:
    return Topology(_vertices(spark, n), _pairs(spark, max(n - 1, 0), F.lit(0), F.col("id") + 1))


def grid(spark: SparkSession, rows: int, columns: int) -> Topology:
    """Right, then down, from each cell by rows."""
    from lodestone.plans.loop import number_rows

    cells = spark.range(rows * columns).select("id", F.expr(f"id div {max(columns, 1)}").alias("r"), (F.col("id") % max(columns, 1)).alias("c"))
    right = cells.where(F.col("c") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.where(F.col("r") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return Topology(_vertices(spark, rows * columns), number_rows(right.unionByName(down), ["src", "dst"], "edge").select("edge", "src", "dst"))


def complete_bipartite(spark: SparkSession, left: int, right: int) -> Topology:
    return Topology(_vertices(spark, left + right), _pairs(spark, left * right, F.expr(f"id div {max(right, 1)}"), F.lit(left) + F.col("id") % max(right, 1)))


def mesh(spark: SparkSession, n: int, edges: int) -> Topology:
    """dst = (src * 37 + layer * 7919 + 17) mod n, one more where that is src; layer = edge div n."""
    i = F.col("id")
    src = i % n
    raw = (src * 37 + F.expr(f"id div {n}") * 7919 + 17) % n
    return Topology(_vertices(spark, n), _pairs(spark, edges, src, F.when(raw == src, (raw + 1) % n).otherwise(raw)))


class RandomGraphs:
    """Seeded Erdos-Renyi graphs. The k-th candidate's draw depends on the seed and k alone (SplitMix64), so candidates are
    drawn in parallel; probabilities 0 and 1 use no draws; one generator's calls follow each other."""

    def __init__(self, spark: SparkSession, seed: int):
        self.spark, self.seed, self.used = spark, seed, 0

    def _draw(self, n: int, count: int, numerator: int, denominator: int, src, dst, directed: bool) -> Topology:
        if denominator == 0 or numerator > denominator:
            raise InvalidProbability(f"probability {numerator}/{denominator}")
        v = _vertices(self.spark, n)
        pairs = self.spark.range(count).select("id", src.cast("long").alias("src"), dst.cast("long").alias("dst"))
        if numerator == 0:
            pairs = pairs.limit(0)
        elif numerator < denominator:
            seed, used = self.seed, self.used
            self.used += count

            @F.pandas_udf(T.BooleanType())
            def taken(k: pd.Series) -> pd.Series:
                with np.errstate(over="ignore"):
                    x = (k.to_numpy(np.uint64) + np.uint64(used + 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    x = x ^ (x >> np.uint64(31))
                return pd.Series(x % np.uint64(denominator) < np.uint64(numerator))

            pairs = pairs.where(taken("id"))
        from lodestone.plans.loop import number_rows

        return Topology(v, number_rows(pairs, ["id"], "edge").select("edge", "src", "dst"), directed)

    def directed(self, n: int, numerator: int, denominator: int) -> Topology:
        m = max(n - 1, 1)
        s, r = F.expr(f"id div {m}"), F.col("id") % m
        return self._draw(n, n * (n - 1), numerator, denominator, s, F.when(r < s, r).otherwise(r + 1), True)

    def _upper(self, n: int, numerator: int, denominator: int, directed: bool) -> Topology:
        # the k-th pair u < v in the order of u: rows from the end have 1, 2, 3, ... pairs
        total = n * (n - 1) // 2
        back = F.lit(total - 1) - F.col("id")
        t = F.floor((F.sqrt(8 * back + 1) - 1) / 2)
        t = F.when(t * (t + 1) / 2 > back, t - 1).when((t + 1) * (t + 2) / 2 <= back, t + 1).otherwise(t).cast("long")
        inside = back - F.floor(t * (t + 1) / 2)
        return self._draw(n, total, numerator, denominator, F.lit(n - 2) - t, F.lit(n - 1) - inside, directed)

    def undirected(self, n: int, numerator: int, denominator: int) -> Topology:
        return self._upper(n, numerator, denominator, False)

    def dag(self, n: int, numerator: int, denominator: int) -> Topology:
        return self._upper(n, numerator, denominator, True)
