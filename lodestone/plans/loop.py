"""Driver loops over plans: distributed row numbers and cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize


def number_rows(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: the place of each row in ``order``, without bringing all rows to one task.

    The rows are range-sorted and written; each partition's rows are counted, and only those counts reach the driver.
    ``scratch.drop`` of the result deletes what was written.
    """
    sorted_ = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_mid", 33)
    counts = sorted_.groupBy(part.alias("p")).count().orderBy("p").collect()
    offsets, total = {}, first
    for r in counts:
        offsets[r["p"]] = total
        total += r["count"]
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    if len(offsets) <= 1:
        out = sorted_.withColumn(name, F.lit(first).cast("long") + inside).drop("_mid")
    else:
        table = df.sparkSession.createDataFrame(list(offsets.items()), "_p long, _offset long")
        out = sorted_.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_offset") + inside).drop("_p", "_offset", "_mid")
    out._lodestone_path = sorted_._lodestone_path
    return out


def top(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (small groups only: a window by key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
