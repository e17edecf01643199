"""Adjacency matrices as tables unique on (i, j): values, or the pairs alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidFormat, InvalidNodeIndex
from lodestone.graph import Topology
from lodestone.plans.loop import number_rows


@dataclass(frozen=True)
class DenseMatrix:
    """``cells`` (i, j, value) of an n by n matrix; a change gives a new matrix."""

    n: int
    cells: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, n: int, kind: str = "double") -> DenseMatrix:
        return cls(n, spark.createDataFrame([], f"i long, j long, value {kind}"))

    def _check(self, *at: int) -> None:
        for k in at:
            if not 0 <= k < self.n:
                raise InvalidNodeIndex(f"node index {k} is outside matrix node count {self.n}")

    def get(self, i: int, j: int):
        row = self.cells.where((F.col("i") == i) & (F.col("j") == j)).select("value").first()
        return None if row is None else row[0]

    def insert(self, i: int, j: int, value) -> DenseMatrix:
        self._check(i, j)
        return self.insert_all(self.cells.sparkSession.createDataFrame([(i, j, value)], self.cells.schema))

    def insert_undirected(self, i: int, j: int, value) -> DenseMatrix:
        self._check(i, j)
        return self.insert_all(self.cells.sparkSession.createDataFrame([(i, j, value), (j, i, value)] if i != j else [(i, j, value)], self.cells.schema))

    def insert_all(self, cells: DataFrame) -> DenseMatrix:
        """Replaces the cells that ``cells`` names."""
        if not cells.where(f"i < 0 or j < 0 or i >= {self.n} or j >= {self.n}").isEmpty():
            raise InvalidNodeIndex("a cell is outside the matrix")
        return DenseMatrix(self.n, self.cells.join(cells.select("i", "j"), ["i", "j"], "left_anti").unionByName(cells))

    def remove(self, i: int, j: int) -> DenseMatrix:
        return DenseMatrix(self.n, self.cells.where(~((F.col("i") == i) & (F.col("j") == j))))

    def outgoing(self, i: int) -> DataFrame:
        return self.cells.where(F.col("i") == i).select("j", "value").orderBy("j")

    def incoming(self, j: int) -> DataFrame:
        return self.cells.where(F.col("j") == j).select("i", "value").orderBy("i")

    def edges(self) -> DataFrame:
        return self.cells.orderBy("i", "j")

    def to_json(self) -> str:
        return json.dumps({"node_count": self.n, "cells": [list(r) for r in self.edges().collect()]})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str, kind: str = "double") -> DenseMatrix:
        d = json.loads(text)
        cells = [tuple(c) for c in d["cells"]]
        if any(not (0 <= c[0] < d["node_count"] and 0 <= c[1] < d["node_count"]) for c in cells):
            raise InvalidFormat("a cell is outside the matrix")
        return cls(d["node_count"], spark.createDataFrame(cells, f"i long, j long, value {kind}"))


@dataclass(frozen=True)
class BitMatrix:
    """A simple relation: distinct ``pairs`` (i, j) below n."""

    n: int
    pairs: DataFrame

    @classmethod
    def from_topology(cls, t: Topology) -> BitMatrix:
        return cls(t.node_count(), t.edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).distinct())

    def contains(self, i: int, j: int) -> bool:
        return not self.pairs.where((F.col("i") == i) & (F.col("j") == j)).isEmpty()

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(i, j, found) for a table of queries, by one join."""
        return queries.join(self.pairs.withColumn("found", F.lit(True)), ["i", "j"], "left").select("i", "j", F.coalesce("found", F.lit(False)).alias("found"))

    def insert_all(self, pairs: DataFrame) -> BitMatrix:
        if not pairs.where(f"i < 0 or j < 0 or i >= {self.n} or j >= {self.n}").isEmpty():
            raise InvalidNodeIndex("a pair is outside the matrix")
        return BitMatrix(self.n, self.pairs.unionByName(pairs).distinct())

    def insert(self, i: int, j: int) -> BitMatrix:
        return self.insert_all(self.pairs.sparkSession.createDataFrame([(i, j)], "i long, j long"))

    def insert_undirected(self, i: int, j: int) -> BitMatrix:
        return self.insert_all(self.pairs.sparkSession.createDataFrame([(i, j), (j, i)], "i long, j long"))

    def remove(self, i: int, j: int) -> BitMatrix:
        return BitMatrix(self.n, self.pairs.where(~((F.col("i") == i) & (F.col("j") == j))))

    def outgoing(self, i: int) -> DataFrame:
        return self.pairs.where(F.col("i") == i).select("j").orderBy("j")

    def incoming(self, j: int) -> DataFrame:
        return self.pairs.where(F.col("j") == j).select("i").orderBy("i")

    def edge_count(self) -> int:
        return self.pairs.count()

    def to_topology(self) -> Topology:
        spark = self.pairs.sparkSession
        e = number_rows(self.pairs, ["i", "j"], "edge").select("edge", F.col("i").alias("src"), F.col("j").alias("dst"))
        return Topology(spark.range(self.n).select(F.col("id").alias("node")), e)

    def to_json(self) -> str:
        return json.dumps({"node_count": self.n, "pairs": [list(r) for r in self.pairs.orderBy("i", "j").collect()]})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> BitMatrix:
        """Repeats count once, whatever was written; pairs outside are refused."""
        d = json.loads(text)
        if any(not (0 <= i < d["node_count"] and 0 <= j < d["node_count"]) for i, j in d["pairs"]):
            raise InvalidFormat("a pair is outside the matrix")
        return cls(d["node_count"], spark.createDataFrame([tuple(p) for p in d["pairs"]], "i long, j long").distinct())
