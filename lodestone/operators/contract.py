"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import drop, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Minima are combined before the shuffle; a hub's rows in the join are divided by AQE."""
    if large:
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    joined = both.join(low, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.where("m <> src").select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component): for every node of an edge between two nodes, the smallest node that it reaches.

    Self-loops and nulls are ignored, so nodes without another neighbour are not returned. The rounds grow with the
    logarithm of the diameter; each round's table is written to the shared folder and replaces the last.
    """
    now = materialize(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    last = print_of(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        new = materialize(_stars(_stars(now, True), False), "stars")
        mark = print_of(new)
        drop(now)
        now = new
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    low = now.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(low)
