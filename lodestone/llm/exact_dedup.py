"""Exact deduplication against immutable snapshots.

A snapshot is written once: its digest groups, and one static binary-fuse filter per shard of its digests. A new batch
is grouped by digest on its own (map-side combined, so a text that fills a third of the batch is a handful of partial
rows), each distinct digest is screened by the filters of every snapshot, and only positives go on to the snapshot's
exact buckets, where the normalised texts are compared byte by byte.

Edge cases: null text counts as the empty text; empty texts are equal to each other; rows of equal doc_id and text are one
document and stay or go together, and rows of equal doc_id and other texts are told apart by their texts; a null doc_id is
below all others, so its rows stay only where no equal text has an id; an empty batch or snapshot gives an empty part;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import drop, folder, materialize, shuffle_partitions

from .common import SQL_LOWER, ascii_lower, mix, table

SHARD_KEYS = 250_000  # digests of a shard, on average: its filter has about 0.3 MB
BROADCAST_IDS = 500_000  # ids of positives sent to every executor at most: 8 MB


class FuseFilter:
    """Three-wise binary fuse filter with 8-bit fingerprints (Graf and Lemire, 2022), peeled in whole layers."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = 0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        return segment, max(1, math.ceil(n * factor / segment) - 2)

    @staticmethod
    def _cells(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * segment
        m = np.uint64(segment - 1)
        at = np.stack([first + (h & m).astype(np.int64), first + segment + ((h >> np.uint64(18)) & m).astype(np.int64), first + 2 * segment + ((h >> np.uint64(36) ^ h >> np.uint64(9)) & m).astype(np.int64)])
        return at, (mix(h) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        segment, count = cls._shape(len(keys))
        for seed in range(1, 200):
            if seed % 20 == 0:
                count += max(1, count // 10)
            size = (count + 2) * segment
            at, prints = cls._cells(keys, seed, segment, count)
            degree = np.bincount(at.ravel(), minlength=size)
            ids = np.zeros(size, np.int64)  # xor of the keys' numbers in each cell
            for row in at:
                np.bitwise_xor.at(ids, row, np.arange(len(keys)))
            layers, gone, look = [], 0, np.flatnonzero(degree == 1)
            while len(look):
                keyed, where = np.unique(ids[look], return_index=True)
                layers.append((keyed, look[where]))
                gone += len(keyed)
                touched = at[:, keyed]
                np.subtract.at(degree, touched.ravel(), 1)
                for row in touched:
                    np.bitwise_xor.at(ids, row, keyed)
                look = np.unique(touched)
                look = look[degree[look] == 1]
            if gone == len(keys):
                cells = np.zeros(size, np.uint8)
                for keyed, own in reversed(layers):
                    cells[own] = 0
                    a = at[:, keyed]
                    cells[own] = prints[keyed] ^ cells[a[0]] ^ cells[a[1]] ^ cells[a[2]]
                return cls(seed, segment, count, cells)
        raise ValueError("no peelable layout found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._cells(np.asarray(keys, np.uint64), self.seed, self.segment, self.count)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == prints


def digests(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """doc_id, old, h (xxhash64 of the normalised text), sha (sha256, hex), size (bytes)."""
    t = docs.select("doc_id", in_snapshot.alias("old"), ascii_lower(F.col("text")).alias("t"))
    return t.select("doc_id", "old", F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("size"))


def group_digests(d: DataFrame) -> DataFrame:
    """One row per distinct text: the largest doc_id and the number of rows, combined before the shuffle."""
    return d.groupBy("h", "sha", "size").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of a snapshot's digests, as rows shard, seed, segment, count, cells."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["h"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [f.seed], "segment": [f.segment], "count": [f.count], "cells": [f.cells.tobytes()]})

    keys = groups.select(F.pmod("h", F.lit(shards)).alias("shard"), "h")
    return keys.groupBy("shard").applyInPandas(build, "shard long, seed long, segment long, count long, cells binary")


@dataclass(frozen=True)
class Snapshot:
    """``docs`` (doc_id, text) that don't change any more, with their digest groups and filters as tables."""

    docs: DataFrame
    groups: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def write(cls, docs: DataFrame, path: str, digested: DataFrame | None = None) -> Snapshot:
        """Writes groups and filters under ``path``. ``digested``: the digests of ``docs``, where they are known."""
        spark = docs.sparkSession
        group_digests(digests(docs, F.lit(True)) if digested is None else digested).write.parquet(f"{path}/groups")
        groups = spark.read.parquet(f"{path}/groups")
        shards = max(shuffle_partitions(spark), math.ceil(groups.count() / SHARD_KEYS))
        build_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
        return cls(docs, groups, spark.read.parquet(f"{path}/filters"), shards)

    @classmethod
    def read(cls, docs: DataFrame, path: str) -> Snapshot:
        """A snapshot written before, of the same ``docs``."""
        spark = docs.sparkSession
        filters = spark.read.parquet(f"{path}/filters")
        row = filters.select("shards").first()
        return cls(docs, spark.read.parquet(f"{path}/groups"), filters, row[0] if row else 1)


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Of groups (h, sha, size, keep_id, group_size), those that the filters don't prove absent from the snapshot.

    A shard's rows are dealt to ``split`` groups by another hash, each beside the shard's filter, so that a batch much
    larger than the snapshot has no larger groups."""
    split = max(1, math.ceil(groups.count() / SHARD_KEYS / shards))

    def check(rows: pa.Table, f: pa.Table) -> pa.Table:
        hit = np.zeros(len(rows), bool)
        if len(f):
            row = f.slice(0, 1).to_pylist()[0]
            hit = FuseFilter(row["seed"], row["segment"], row["count"], np.frombuffer(row["cells"], np.uint8)).contains(rows.column("h").to_numpy().view(np.uint64))
        return rows.filter(pa.array(hit)).select(["h", "sha", "size", "keep_id", "group_size"])

    left = groups.withColumn("shard", F.pmod("h", F.lit(shards))).withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(split)))
    right = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(check, "h long, sha string, size int, keep_id long, group_size long")


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (sha, old_id, keep_id): the sha of those whose normalised texts are the same bytes. Texts are fetched by id
    and digest, so other texts of the same id don't matter."""
    ids = pairs.select("sha", F.explode(F.array("old_id", "keep_id")).alias("id"))
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("t"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id"))).where(F.sha2("t", 256) == F.col("sha"))
    return texts.groupBy("sha").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).where("n >= 2 and a = b").select("sha")


def positives(docs: DataFrame, groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(sha, keep_id, group_size) of the groups of a batch whose text the snapshot has, byte by byte, united with it."""
    maybe = materialize(screen(groups, snapshot.filters, snapshot.shards), "screened")
    old = snapshot.groups.select("h", "sha", "size", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    found = materialize(maybe.join(old, ["h", "sha", "size"]), "positives")
    sure = same_bytes(docs, found.select("sha", "old_id", "keep_id"))
    out = materialize(found.join(sure, "sha").select("sha", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size")), "united")
    drop(maybe), drop(found)
    return out


def _rows(d: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of digests ``d`` with their class; ``classes`` has the texts of two rows or more."""
    out = d.select("doc_id", "sha").join(classes, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup_batch(batch: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """Every row of ``batch`` with keep_id, group_size, kept and text_sha256 over the batch and all ``snapshots``; their
    rows aren't returned."""
    d = materialize(digests(batch, F.lit(False)), "digests")
    new = materialize(group_digests(d), "batch")
    every = new.select("sha", "keep_id", "group_size")
    for s in snapshots:
        docs = batch.select("doc_id", "text").unionByName(s.docs.select("doc_id", "text"))
        every = every.unionByName(positives(docs, new, s).join(new.select("sha", F.col("group_size").alias("own")), "sha").select("sha", "keep_id", (F.col("group_size") - F.col("own")).alias("group_size")))
    classes = materialize(every.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1"), "groups")
    return _rows(d, classes)


def exact_dedup(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256; of equal texts the largest doc_id stays.

    ``in_snapshot`` (Column) tells the rows of the earlier, immutable snapshot from those of the new batch.
    """
    spark = docs.sparkSession
    d = materialize(digests(docs, in_snapshot), "digests")
    old = Snapshot.write(docs.where(in_snapshot), f"{folder(spark)}/snapshot-{uuid.uuid4().hex}", d.where("old"))
    new = materialize(group_digests(d.where("not old")), "batch")
    both = positives(docs, new, old)
    rest = old.groups.select("sha", "keep_id", "group_size").unionByName(new.select("sha", "keep_id", "group_size")).where("group_size > 1").join(both.select("sha"), "sha", "left_anti")
    # Only groups of two rows or more need the way back to their rows. They are written first, so that this join has its
    # own exchanges and AQE can divide a hot digest's rows.
    classes = materialize(both.unionByName(rest), "groups")
    drop(new), drop(both)
    return _rows(d, classes)


def snapshot_half(doc_id):
    """The rows that the queries take as the earlier snapshot: a fixed half by the id's hash."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0, F.lit(False))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), snapshot_half(F.col("doc_id")))


ORACLE = f"""
WITH t AS (SELECT doc_id, {SQL_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t"""
