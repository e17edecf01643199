"""Graphs and topologies as JSON, and as Parquet, the native form. Reading always validates again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import errors, schema
from lodestone.graph import EvidenceGraph, Topology
from lodestone.scratch import materialize

#: Elements of a document that ``documents`` makes; Spark reads some thousands of rows of a table at once.
DOCUMENT = 100

_NODE_JSON = "struct<id:string,label:string,kind:string,language:string,span:struct<file:string,start:struct<line:bigint,column:bigint>,end:struct<line:bigint,column:bigint>>,attributes:variant>"
_EDGE_JSON = "struct<source:string,target:string,kind:string,provenance:struct<extractor:string,evidence:string,confidence:string,span:struct<file:string,start:struct<line:bigint,column:bigint>,end:struct<line:bigint,column:bigint>>,detail:string>,attributes:variant>"


def from_json(text: DataFrame, column: str = "value") -> EvidenceGraph:
    """Of rows that each hold a document {nodes, edges}; documents are merged."""
    doc = text.select(F.from_json(column, f"struct<nodes:array<{_NODE_JSON}>,edges:array<{_EDGE_JSON}>>").alias("d"))
    if not doc.where("d is null or d.nodes is null or d.edges is null").isEmpty():
        raise errors.InvalidFormat("a graph is an object with nodes and edges")
    n = materialize(doc.select(F.inline("d.nodes")).withColumn("attributes", F.to_json("attributes")), "nodes")  # parsed once, read by every check
    e = materialize(doc.select(F.inline("d.edges")).withColumn("attributes", F.to_json("attributes")), "edges")
    return EvidenceGraph.from_parts(n, e)


def read_json(spark: SparkSession, path: str) -> EvidenceGraph:
    return from_json(spark.read.text(path, wholetext=True))


def element_lines(g: EvidenceGraph) -> DataFrame:
    """(kind, place, line): a JSON text per element, null fields and empty attributes left out."""

    def line(df, names, kind, place):
        fields = F.to_json(F.struct(*names), {"ignoreNullFields": "true"})
        attributes = F.when(F.col("attributes").isNotNull(), F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"attributes":'), F.col("attributes"), F.lit("}"))).otherwise(F.col("line"))
        return df.withColumn("line", fields).select(F.lit(kind).alias("kind"), F.col(place).alias("place"), attributes.alias("line"))

    return line(g.nodes, ["id", "label", "kind", "language", "span"], "node", "idx").unionByName(line(g.edges, ["source", "target", "kind", "provenance"], "edge", "edge"))


def documents(g: EvidenceGraph, elements: int = DOCUMENT) -> DataFrame:
    """(value): the graph as documents {nodes, edges} of up to ``elements`` nodes or edges each, which ``from_json`` merges.

    Elements come in their order, so a document's size is bounded whatever the graph's."""
    lines = element_lines(g).groupBy("kind", F.floor(F.col("place") / elements).alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: e["line"]), ",")
    out = lines.select(F.when(F.col("kind") == "node", F.concat(F.lit('{"nodes":['), text, F.lit('],"edges":[]}'))).otherwise(F.concat(F.lit('{"nodes":[],"edges":['), text, F.lit("]}"))).alias("value"))
    empty = g.nodes.sparkSession.createDataFrame([('{"nodes":[],"edges":[]}',)], "value string")
    return out.unionByName(empty)


def to_json(g: EvidenceGraph) -> str:
    """The whole graph as one text {nodes, edges}; for graphs that fit in the driver."""
    rows = element_lines(g).orderBy("kind", "place").collect()
    part = lambda kind: ",".join(r["line"] for r in rows if r["kind"] == kind)
    return f'{{"nodes":[{part("node")}],"edges":[{part("edge")}]}}'


def write_parquet(g: EvidenceGraph, path: str) -> None:
    g.nodes.sortWithinPartitions("id").write.parquet(f"{path}/nodes.parquet")
    g.edges.sortWithinPartitions("source", "edge").write.parquet(f"{path}/edges.parquet")


def read_parquet(spark: SparkSession, path: str) -> EvidenceGraph:
    """Validates and numbers again: files can't get around the rules."""
    e = spark.read.parquet(f"{path}/edges.parquet")
    return EvidenceGraph.from_parts(spark.read.parquet(f"{path}/nodes.parquet").select(*schema.NODE.fieldNames()), e.select(*schema.EDGE.fieldNames()))


def topology_to_json(t: Topology) -> str:
    pairs = [[r["src"], r["dst"]] for r in t.edges.orderBy("edge").select("src", "dst").collect()]
    return json.dumps({"node_count": t.node_count(), "edges": pairs})


def topology_from_json(spark: SparkSession, text: str, directed: bool = True) -> Topology:
    d = json.loads(text)
    if set(d) != {"node_count", "edges"}:
        raise errors.InvalidFormat("a topology is an object with node_count and edges")
    return Topology.from_edges(spark, d["node_count"], [tuple(x) for x in d["edges"]], directed=directed)
