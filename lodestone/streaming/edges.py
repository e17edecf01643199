"""Streams of edge changes: an extension, as the graph model itself is batch.

A change stream has (seq, op, edge, src, dst), op upsert or remove. ``upsert_edges`` keeps the folded edge table by
micro-batches: each writes the next version beside the last, so a batch that is run again after a failure gives the same
version. A version keeps the last change of every edge, removals too: an upsert that comes late doesn't bring an edge back. ``windowed_degrees`` counts per event-time window with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.mutable import last_changes

CHANGE = "seq long, op string, edge long, src long, dst long"


def version_path(path: str, batch: int) -> str:
    return f"{path}/version={batch}"


def current_edges(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.parquet(version_path(path, batch)).where("op <> 'remove'").select("edge", "src", "dst", "seq")


def upsert_edges(changes: DataFrame, path: str, checkpoint: str):
    """Starts the query that folds ``changes`` into versions under ``path`` (available-now: it ends with the input)."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = batch.select("seq", "op", "edge", "src", "dst")
        if number:
            log = log.unionByName(spark.read.parquet(version_path(path, number - 1)))
        last_changes(log, ["edge"]).select("seq", "op", "edge", "src", "dst").write.mode("overwrite").parquet(version_path(path, number))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_degrees(edges: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, node, out_degree) of a stream with ts, src: counts that are final once the watermark has passed."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
