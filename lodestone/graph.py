"""Topologies (dense integer nodes and edges) and evidence graphs (named nodes, edges with provenance)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.plans import canonical
from lodestone.plans.loop import number_rows
from lodestone.scratch import materialize

U32 = (1 << 32) - 1


@dataclass(frozen=True)
class Topology:
    """``vertices`` (node long) and ``edges`` (edge, src, dst long, and any payload). Parallel edges and loops are allowed."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, spark: SparkSession, node_count: int, pairs: list[tuple], columns: tuple[str, ...] = (), directed: bool = True, types: str = "long") -> Topology:
        """From pairs (src, dst, payload...), numbered in their order; endpoints must be below ``node_count``."""
        if node_count > U32 or len(pairs) > U32:
            raise errors.IndexCapacityExceeded(f"{max(node_count, len(pairs))} exceeds the index capacity")
        for k, p in enumerate(pairs):
            if not (0 <= p[0] < node_count and 0 <= p[1] < node_count):
                raise errors.InvalidTopologyEndpoint(f"edge {k} refers to a node outside {node_count}")
        kinds = "".join(f", {c} {types}" for c in columns)
        rows = [(k, *p) for k, p in enumerate(pairs)]
        return cls(spark.range(node_count).select(F.col("id").alias("node")), spark.createDataFrame(rows, "edge long, src long, dst long" + kinds), directed)

    def checked(self) -> Topology:
        """The same, after a distributed check that every endpoint is a vertex."""
        v = self.vertices
        lost = self.edges.join(v, self.edges["src"] == v["node"], "left_anti").unionByName(self.edges.join(v, self.edges["dst"] == v["node"], "left_anti")).agg(F.min("edge")).first()[0]
        if lost is not None:
            raise errors.InvalidTopologyEndpoint(f"edge {lost} refers to a node outside the topology")
        return self

    # Views: lazy, no data moves.
    def reversed(self) -> Topology:
        rest = [c for c in self.edges.columns if c not in ("edge", "src", "dst")]
        return Topology(self.vertices, self.edges.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.directed)

    def filter_edges(self, keep: Column | str) -> Topology:
        """All vertices, the edges for which ``keep`` holds."""
        return Topology(self.vertices, self.edges.where(keep), self.directed)

    def induced(self, keep: DataFrame | Column | str) -> Topology:
        """The vertices kept (a condition on ``node`` or a table of nodes) and the edges between them."""
        v = self.vertices.join(keep.select("node").distinct(), "node", "left_semi") if isinstance(keep, DataFrame) else self.vertices.where(keep)
        e = self.edges.join(v, self.edges["src"] == v["node"], "left_semi")
        return Topology(v, e.join(v, e["dst"] == v["node"], "left_semi"), self.directed)

    def undirected(self) -> Topology:
        return Topology(self.vertices, self.edges, False)

    def node_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def is_empty(self) -> bool:
        return self.vertices.isEmpty()

    def arcs(self, direction: str = "outgoing", payload: tuple[str, ...] = ()) -> DataFrame:
        """(a, b, flag, edge, payload): steps from a to b; with ``both`` incoming ones follow outgoing ones (flag 1)."""
        e = self.edges
        out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("flag"), "edge", *payload)
        back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("flag"), "edge", *payload)
        if direction not in ("outgoing", "incoming", "both"):
            raise errors.InvalidAlgorithmParameter(f"direction {direction}")
        if not self.directed or direction == "both":
            return out.unionByName(back)
        return out if direction == "outgoing" else back.withColumn("flag", F.lit(0))

    def neighbours(self, node: int, direction: str = "outgoing") -> DataFrame:
        """(edge, neighbour, flag) of one node, in edge order."""
        return self.arcs(direction).where(F.col("a") == node).select("edge", F.col("b").alias("neighbour"), "flag").orderBy("flag", "edge")

    def degrees(self, direction: str = "outgoing") -> DataFrame:
        """(node, degree) of every vertex; parallel edges count, an undirected loop counts twice."""
        d = self.arcs(direction).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
        return self.vertices.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def persisted(self) -> Topology:
        """Written to the shared folder: for loops that read it again and again."""
        return Topology(materialize(self.vertices, "vertices"), materialize(self.edges, "edges"), self.directed)


@dataclass(frozen=True)
class EvidenceGraph:
    """Canonical nodes (idx, id, ...) and edges (edge, src, dst, source, target, ...), numbered in canonical order."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_parts(cls, nodes: DataFrame, edges: DataFrame) -> EvidenceGraph:
        """Validates, removes repeats, sorts and numbers. The result doesn't depend on the order of the input."""
        n = number_rows(canonical.canonical_nodes(nodes), [F.col("id")], "idx")
        e = number_rows(canonical.canonical_edges(edges, n), canonical.edge_order(), "edge").drop("attr_key")
        ids = n.select(F.col("idx"), F.col("id"))
        e = e.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "source").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "target")
        return cls(n, e.select("edge", "src", "dst", "source", "target", "kind", "provenance", "attributes"))

    @property
    def topology(self) -> Topology:
        return Topology(self.nodes.select(F.col("idx").alias("node")), self.edges)

    def filter_edges(self, keep: Column | str) -> EvidenceGraph:
        return EvidenceGraph(self.nodes, self.edges.where(keep))

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def node_index(self, node_id: str) -> int | None:
        row = self.node(node_id).select("idx").first()
        return None if row is None else row[0]

    def node_at(self, idx: int) -> DataFrame:
        return self.nodes.where(F.col("idx") == idx)

    def edge_at(self, edge: int) -> DataFrame:
        return self.edges.where(F.col("edge") == edge)

    def outgoing(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("source") == node_id).orderBy("edge")

    def incoming(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("target") == node_id).orderBy("edge")

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def named(self, df: DataFrame, column: str = "node") -> DataFrame:
        """Adds the ids of the indexes in ``column`` as ``column_id``."""
        return df.join(self.nodes.select(F.col("idx").alias(column), F.col("id").alias(f"{column}_id")), column)


class GraphBuilder:
    """Collects nodes and edges, in any order and as rows or tables, and builds the canonical graph."""

    def __init__(self, spark: SparkSession):
        from lodestone import schema

        self.spark, self.schema = spark, schema
        self._nodes: list = []
        self._edges: list = []

    def add_node(self, node: dict | DataFrame) -> GraphBuilder:
        self._nodes.append(node)
        return self

    def add_edge(self, edge: dict | DataFrame) -> GraphBuilder:
        self._edges.append(edge)
        return self

    def _table(self, parts: list, kind) -> DataFrame:
        names = kind.fieldNames()
        rows = [tuple(p.get(n) for n in names) for p in parts if isinstance(p, dict)]
        out = self.spark.createDataFrame(rows, kind)
        for p in parts:
            if isinstance(p, DataFrame):
                out = out.unionByName(p.select(*names))
        return out

    def build(self) -> EvidenceGraph:
        return EvidenceGraph.from_parts(self._table(self._nodes, self.schema.NODE), self._table(self._edges, self.schema.EDGE))
