"""The graph by string ids: the small surface that most callers need. Unknown ids are errors here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidNodeIndex
from lodestone.graph import EvidenceGraph
from lodestone.operators import components, dag, rank, traversal
from lodestone.sources import graph_json, text_formats


class NamedGraph:
    def __init__(self, graph: EvidenceGraph):
        self.graph = graph

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> NamedGraph:
        return cls(graph_json.from_json(spark.createDataFrame([(text,)], "value string")))

    def _index(self, node_id: str) -> int:
        k = self.graph.node_index(node_id)
        if k is None:
            raise InvalidNodeIndex(f"unknown node {node_id!r}")
        return k

    def _ids(self, df: DataFrame, order: str = "position") -> list[str]:
        return [r["node_id"] for r in self.graph.named(df).orderBy(order).collect()]

    def node_count(self) -> int:
        return self.graph.node_count()

    def edge_count(self) -> int:
        return self.graph.edge_count()

    def canonical(self) -> str:
        return graph_json.to_json(self.graph)

    def node(self, node_id: str):
        self._index(node_id)
        return self.graph.node(node_id).first()

    def outgoing(self, node_id: str) -> list:
        self._index(node_id)
        return self.graph.outgoing(node_id).collect()

    def incoming(self, node_id: str) -> list:
        self._index(node_id)
        return self.graph.incoming(node_id).collect()

    def bfs(self, start: str, direction: str = "outgoing") -> list[str]:
        return self._ids(traversal.bfs(self.graph.topology, self._index(start), direction))

    def shortest_path(self, start: str, target: str) -> list[str] | None:
        found = traversal.shortest_path(self.graph.topology, self._index(start), self._index(target))
        if found is None:
            return None
        names = {r["idx"]: r["id"] for r in self.graph.nodes.where(F.col("idx").isin(found)).select("idx", "id").collect()}
        return [names[k] for k in found]

    def strongly_connected_components(self) -> list[list[str]]:
        c = self.graph.named(components.strongly_connected(self.graph.topology))
        rows = c.groupBy("component").agg(F.sort_array(F.collect_list("node_id")).alias("ids")).orderBy("component").collect()
        return [list(r["ids"]) for r in rows]

    def topological_sort(self) -> list[str] | None:
        order = dag.topological(self.graph.topology)
        return None if order is None else self._ids(order)

    def has_cycle(self) -> bool:
        return dag.has_cycle(self.graph.topology)

    def page_rank(self, damping: float = 0.85, iterations: int = 20) -> dict[str, float]:
        return {r["node_id"]: r["score"] for r in self.graph.named(rank.page_rank(self.graph.topology, damping, iterations)).collect()}

    def to_dot(self) -> str:
        return text_formats.to_dot(self.graph.topology)
