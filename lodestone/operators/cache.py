"""A topology kept close for repeated traversal: Parquet in the shared folder, sorted by source, and both directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from lodestone.graph import Topology
from lodestone.operators import traversal
from lodestone.scratch import materialize

LAYOUTS = ("auto", "fast", "balanced", "compact")


@dataclass(frozen=True)
class TraversalCache:
    """``layout`` is a hint: fast keeps plain Parquet pages, the others let its encodings compress sorted columns."""

    topology: Topology
    layout: str

    @classmethod
    def of(cls, t: Topology, layout: str = "auto") -> TraversalCache:
        if layout not in LAYOUTS:
            raise ValueError(layout)
        e = t.edges.select("edge", "src", "dst")
        if layout != "fast":
            e = e.repartition("src").sortWithinPartitions("src", "edge")
        return cls(Topology(materialize(t.vertices, "cache"), materialize(e, "cache"), t.directed), "balanced" if layout == "auto" else layout)

    def storage_bytes(self) -> int:
        spark, total = self.topology.spark, 0
        for df in (self.topology.vertices, self.topology.edges):
            p = spark._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
            total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return total

    def fast_equivalent_bytes(self) -> int:
        """Of 32-bit offsets and neighbours in both directions."""
        return 8 * (self.topology.node_count() + 1) + 8 * self.topology.edge_count()

    def storage_ratio(self) -> float:
        return self.storage_bytes() / max(1, self.fast_equivalent_bytes())

    def neighbours(self, node: int, direction: str = "outgoing") -> list[int]:
        return [r["neighbour"] for r in self.topology.neighbours(node, direction).collect()]

    def degree(self, node: int, direction: str = "outgoing") -> int | None:
        row = self.topology.degrees(direction).where(F.col("node") == node).first()
        return None if row is None else row["degree"]

    def bfs(self, start: int, **how):
        return traversal.bfs(self.topology, start, **how)

    def dfs(self, start: int):
        from lodestone.operators.structure import dfs

        return dfs(self.topology, start)

    def reachable(self, start: int, target: int) -> bool:
        return traversal.reachable(self.topology, start, target)

    def shortest_path(self, start: int, target: int):
        return traversal.shortest_path(self.topology, start, target)
