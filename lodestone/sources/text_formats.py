"""DOT, Graph6 and GraphML.

Writers are rows of text in order, so large graphs are written by ``write.text``; parsers take one document's text.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidFormat, UnsupportedGraphFeature
from lodestone.graph import Topology


def _ordered(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "place", "second").select("value")


def _line(spark: SparkSession, section: int, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("second"), F.lit(text).alias("value"))


def dot_lines(t: Topology) -> DataFrame:
    """(value): a strict graph, nodes then edges by number; edge identity and repeats are lost."""
    spark, arrow = t.spark, "->" if t.directed else "--"
    e = t.edges.select("src", "dst").distinct() if t.directed else t.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return _ordered([
        _line(spark, 0, f"strict {'digraph' if t.directed else 'graph'} G {{"),
        t.vertices.select(F.lit(1).alias("section"), F.col("node").alias("place"), F.lit(0).cast("long").alias("second"), F.format_string("  n%d;", "node").alias("value")),
        e.select(F.lit(2).alias("section"), F.col("src").alias("place"), F.col("dst").alias("second"), F.format_string(f"  n%d {arrow} n%d;", "src", "dst").alias("value")),
        _line(spark, 3, "}"),
    ])


def to_dot(t: Topology) -> str:
    return "".join(r[0] + "\n" for r in dot_lines(t).collect())


_NODE_ID = re.compile(r'"?n?(\d+)"?\Z')


def parse_dot(text: str, directed: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """(node count, edges): the largest number plus one; statements end at ``;`` or line ends."""
    text = re.sub(r"(//|#)[^\n]*", "", text)
    m = re.match(r"\s*(?:strict\s+)?(digraph|graph)\b[^{]*\{(.*)\}\s*\Z", text, re.S)
    if not m:
        raise InvalidFormat("DOT: no graph")
    if (m[1] == "digraph") != directed:
        raise InvalidFormat(f"DOT: a {m[1]} where a {'digraph' if directed else 'graph'} is expected")
    edges, top = [], -1
    for statement in re.split(r"[;\n]", re.sub(r"\[[^\]]*\]", "", m[2])):
        statement = statement.strip()
        if not statement or re.match(r"(graph|node|edge)\b", statement) or ("=" in statement and "-" not in statement):
            continue
        if ("--" if directed else "->") in statement:
            raise InvalidFormat("DOT: an arrow of the other kind")
        chain = []
        for part in statement.split("->" if directed else "--"):
            n = _NODE_ID.match(part.strip())
            if not n:
                raise InvalidFormat(f"DOT: node {part.strip()!r}")
            chain.append(int(n[1]))
        top = max(top, *chain)
        edges += list(zip(chain, chain[1:], strict=False))
    return top + 1, edges


def from_dot(spark: SparkSession, text: str, directed: bool = True) -> Topology:
    n, edges = parse_dot(text, directed)
    return Topology.from_edges(spark, n, edges, directed=directed)


def encode_graph6(n: int, edges: list[tuple[int, int]]) -> str:
    """Of a simple undirected graph: size, then the upper triangle by columns in groups of six bits."""
    pairs = {(min(e), max(e)) for e in edges}
    if any(u == v for u, v in edges):
        raise UnsupportedGraphFeature("Graph6: a loop")
    if len(pairs) < len(edges):
        raise UnsupportedGraphFeature("Graph6: parallel edges")
    if n <= 62:
        head = [n]
    elif n <= 258047:
        head = [63, n >> 12 & 63, n >> 6 & 63, n & 63]
    else:
        head = [63, 63, *(n >> s & 63 for s in (30, 24, 18, 12, 6, 0))]
    groups = [0] * ((n * (n - 1) // 2 + 5) // 6)
    for u, v in pairs:
        k = v * (v - 1) // 2 + u
        groups[k // 6] |= 32 >> k % 6
    return "".join(chr(63 + x) for x in head + groups)


def decode_graph6(text: str) -> tuple[int, list[tuple[int, int]]]:
    text = text.strip("\r\n").removeprefix(">>graph6<<")
    data = [ord(c) - 63 for c in text]
    if not data or any(not 0 <= x <= 63 for x in data):
        raise InvalidFormat("Graph6: a byte outside the alphabet")
    size = 1 if data[0] < 63 else 4 if len(data) > 1 and data[1] < 63 else 8
    digits = data[:1] if size == 1 else data[1:4] if size == 4 else data[2:8]
    if len(data) < size:
        raise InvalidFormat("Graph6: too short")
    n = 0
    for x in digits:
        n = n << 6 | x
    body, bits = data[size:], n * (n - 1) // 2
    if len(body) != (bits + 5) // 6:
        raise InvalidFormat("Graph6: wrong length")
    if body and body[-1] & (1 << (-bits % 6)) - 1:
        raise InvalidFormat("Graph6: padding isn't zero")
    edges, k = [], 0
    for v in range(1, n):
        for u in range(v):
            if body[k // 6] & 32 >> k % 6:
                edges.append((u, v))
            k += 1
    return n, edges


def to_graph6(t: Topology) -> str:
    from lodestone.kernels.run import run

    def kernel(g):
        if g.names != list(range(g.n)):
            raise UnsupportedGraphFeature("Graph6: nodes aren't numbered from 0 without gaps")
        return [(encode_graph6(g.n, g.edges),)]

    row = run(t, kernel, "value string").first()
    return row[0] if row else encode_graph6(0, [])


def read_graph6(lines: DataFrame, column: str = "value") -> DataFrame:
    """(graph, node_count, src, dst) of a table of records; each row is decoded where it lies."""

    def task(batches):
        for pdf in batches:
            rows = []
            for text in pdf[column]:
                n, edges = decode_graph6(text)
                rows += [(text, n, u, v) for u, v in edges] or [(text, n, None, None)]
            yield pd.DataFrame(rows, columns=["graph", "node_count", "src", "dst"]).astype({"src": "Int64", "dst": "Int64"})

    return lines.select(column).mapInPandas(task, "graph string, node_count long, src long, dst long")


def graphml_lines(t: Topology) -> DataFrame:
    spark = t.spark
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <graph id="G" edgedefault="{"directed" if t.directed else "undirected"}">'
    return _ordered([
        _line(spark, 0, head),
        t.vertices.select(F.lit(1).alias("section"), F.col("node").alias("place"), F.lit(0).cast("long").alias("second"), F.format_string('    <node id="n%d"/>', "node").alias("value")),
        t.edges.select(F.lit(2).alias("section"), F.col("edge").alias("place"), F.lit(0).cast("long").alias("second"), F.format_string('    <edge id="e%d" source="n%d" target="n%d"/>', "edge", "src", "dst").alias("value")),
        _line(spark, 3, "  </graph>\n</graphml>"),
    ])


def to_graphml(t: Topology) -> str:
    return "".join(r[0] + "\n" for r in graphml_lines(t).collect())


def parse_graphml(text: str) -> tuple[list[str], list[tuple[int, int]], bool]:
    """(node ids in order of declaration, edges by their places, directed)."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise UnsupportedGraphFeature("GraphML: a document type")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        raise InvalidFormat(f"GraphML: {error}") from None
    tag = lambda x: x.tag.rpartition("}")[2]
    every = list(root.iter())
    for x in every:
        if tag(x) in ("hyperedge", "port", "locator"):
            raise UnsupportedGraphFeature(f"GraphML: {tag(x)}")
    graphs = [x for x in every if tag(x) == "graph"]
    if len(graphs) != 1:
        raise InvalidFormat("GraphML: not exactly one graph")
    kind = graphs[0].get("edgedefault")
    if kind not in ("directed", "undirected"):
        raise InvalidFormat("GraphML: edgedefault is missing")
    ids: dict[str, int] = {}
    for x in every:
        if tag(x) == "node":
            if x.get("id") is None or x.get("id") in ids:
                raise InvalidFormat("GraphML: a node without id, or twice")
            ids[x.get("id")] = len(ids)
    edges = []
    for x in every:
        if tag(x) == "edge":
            if x.get("directed") is not None:
                raise UnsupportedGraphFeature("GraphML: an edge's own direction")
            if x.get("source") not in ids or x.get("target") not in ids:
                raise InvalidFormat("GraphML: an edge to no node")
            edges.append((ids[x.get("source")], ids[x.get("target")]))
    return list(ids), edges, kind == "directed"


def from_graphml(spark: SparkSession, text: str) -> tuple[Topology, list[str]]:
    ids, edges, directed = parse_graphml(text)
    return Topology.from_edges(spark, len(ids), edges, directed=directed), ids


def read_graph_files(spark: SparkSession, path: str, kind: str, directed: bool = True) -> DataFrame:
    """(path, node_count, src, dst) of all files under ``path``, each parsed in the task that reads it. ``kind``: dot or
    graphml (a graph per file), or graph6 (a graph per line)."""
    if kind not in ("dot", "graphml", "graph6"):
        raise InvalidFormat(f"no format {kind}")
    files = spark.read.text(path, wholetext=kind != "graph6").select(F.col("_metadata.file_path").alias("path"), "value")

    def task(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["path"], pdf["value"], strict=True):
                if kind == "dot":
                    n, edges = parse_dot(text, directed)
                elif kind == "graph6":
                    n, edges = decode_graph6(text)
                else:
                    ids, edges, _ = parse_graphml(text)
                    n = len(ids)
                rows += [(name, n, u, v) for u, v in edges] or [(name, n, None, None)]
            yield pd.DataFrame(rows, columns=["path", "node_count", "src", "dst"]).astype({"src": "Int64", "dst": "Int64"})

    return files.mapInPandas(task, "path string, node_count long, src long, dst long")
