"""Validation and canonical form of evidence graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import errors, schema
from lodestone.functions.attributes import attribute_key, canonical_json

_TRIMMED = r"^\S(?s:.*\S)?$"


def _kind_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(_TRIMMED), F.lit(False))


def _span_ok(s: Column) -> Column:
    a, b = s["start"], s["end"]
    ok = (F.length(s["file"]) > 0) & (a["line"] >= 1) & (a["column"] >= 1) & (b["line"] >= 1) & (b["column"] >= 1) & ((b["line"] > a["line"]) | ((b["line"] == a["line"]) & (b["column"] >= a["column"])))
    return s.isNull() | F.coalesce(ok, F.lit(False))


def _fail(df: DataFrame, checks: list[tuple[Column, type, Column]]) -> None:
    """Raises the first failing check's error, with one example; all are looked for in a single pass."""
    row = df.agg(*[F.min(F.when(~ok, F.coalesce(what, F.lit("")))).alias(f"c{k}") for k, (ok, _, what) in enumerate(checks)]).first()
    for k, (_, error, _) in enumerate(checks):
        if row[k] is not None:
            raise error(row[k])


def check_nodes(nodes: DataFrame) -> None:
    c = F.col
    _fail(nodes, [
        (F.coalesce(F.length("id") > 0, F.lit(False)), errors.EmptyNodeId, F.lit("node id is empty")),
        (_kind_ok(c("kind")), errors.InvalidKind, F.concat(F.lit("node kind: "), F.coalesce("kind", F.lit("null")))),
        (c("language").isNull() | _kind_ok(c("language")), errors.InvalidKind, F.concat(F.lit("language: "), "language")),
        (_span_ok(c("span")), errors.InvalidSpan, F.concat(F.lit("span of "), "id")),
    ])


def check_edges(edges: DataFrame) -> None:
    p = F.col("provenance")
    _fail(edges, [
        (_kind_ok(F.col("kind")), errors.InvalidKind, F.concat(F.lit("edge kind: "), F.coalesce("kind", F.lit("null")))),
        (_kind_ok(p["evidence"]), errors.InvalidKind, F.concat(F.lit("evidence kind: "), F.coalesce(p["evidence"], F.lit("null")))),
        (F.coalesce(F.length(p["extractor"]) > 0, F.lit(False)), errors.EmptyExtractor, F.lit("provenance without extractor")),
        (_span_ok(p["span"]), errors.InvalidSpan, F.concat(F.lit("span of edge from "), "source")),
    ])


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """Valid, unique nodes in the model's types; equal repeats are one node, different ones conflict."""
    n = nodes.select("id", "label", "kind", "language", F.col("span").cast(schema.SPAN).alias("span"), canonical_json(F.col("attributes").cast("string")).alias("attributes"))
    check_nodes(n)
    n = n.dropDuplicates()
    twice = n.groupBy("id").count().where("count > 1").select(F.min("id")).first()[0]
    if twice is not None:
        raise errors.ConflictingNode(twice)
    return n


def edge_order() -> list[Column]:
    """The total order of edges: fields in turn, kinds by rank with custom ones last, nulls first."""
    c, p = F.col, F.col("provenance")
    span = p["span"]
    return [
        c("source"), c("target"), schema.rank(c("kind"), schema.EDGE_KINDS), schema.custom(c("kind"), schema.EDGE_KINDS),
        p["extractor"], schema.rank(p["evidence"], schema.EVIDENCE_KINDS), schema.custom(p["evidence"], schema.EVIDENCE_KINDS), schema.rank(p["confidence"], schema.CONFIDENCES),
        span["file"].asc_nulls_first(), span["start"]["line"], span["start"]["column"], span["end"]["line"], span["end"]["column"],
        p["detail"].asc_nulls_first(), c("attr_key"),
    ]


def canonical_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid edges between existing nodes, repeats equal in every field removed; with attr_key for their order."""
    e = edges.select("source", "target", "kind", F.col("provenance").cast(schema.PROVENANCE).alias("provenance"), canonical_json(F.col("attributes").cast("string")).alias("attributes"))
    check_edges(e)
    ids = nodes.select("id")
    lost = e.join(ids, e["source"] == ids["id"], "left_anti").agg(F.min("source")).first()[0]
    if lost is not None:
        raise errors.MissingEdgeSource(f"edge source does not exist: {lost}")
    lost = e.join(ids, e["target"] == ids["id"], "left_anti").agg(F.min("target")).first()[0]
    if lost is not None:
        raise errors.MissingEdgeTarget(f"edge target does not exist: {lost}")
    return e.dropDuplicates().withColumn("attr_key", attribute_key("attributes"))
