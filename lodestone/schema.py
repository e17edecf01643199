"""Types, kinds and ranks of the evidence model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The known kinds in rank order; other kinds are custom and rank after them.
NODE_KINDS = ("repository", "file", "module", "package", "function", "method", "struct", "enum", "trait", "type_alias", "constant", "static", "service", "endpoint", "table", "column", "topic", "consumer_group", "exchange", "queue", "binding", "collection", "index", "kubernetes_resource", "container", "config_key", "unknown")
EDGE_KINDS = ("contains", "imports", "calls", "references", "method", "implements", "re_exports", "depends_on", "inherits", "publishes", "consumes", "binds", "reads", "writes", "deploys", "exposes", "mounts", "configures")
EVIDENCE_KINDS = ("EXACT_LSP", "EXTRACTED", "RESOLVED", "INFERRED", "CONFLICT", "parsed", "resolved", "manifest", "literal", "toolchain", "runtime")
CONFIDENCES = ("exact", "high", "medium", "low")

_POSITION = T.StructType([T.StructField("line", T.LongType()), T.StructField("column", T.LongType())])
SPAN = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", _POSITION), T.StructField("end", _POSITION)])
PROVENANCE = T.StructType([T.StructField("extractor", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("span", SPAN), T.StructField("detail", T.StringType())])
NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("language", T.StringType()), T.StructField("span", SPAN), T.StructField("attributes", T.StringType())])
EDGE = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("provenance", PROVENANCE), T.StructField("attributes", T.StringType())])
TOPOLOGY_EDGE = "edge long, src long, dst long"


def rank(kind: Column, known: tuple[str, ...]) -> Column:
    """Place among the known kinds; custom kinds come last."""
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(known)], F.lit(len(known)))


def custom(kind: Column, known: tuple[str, ...]) -> Column:
    """The kind where it is custom, else empty: orders custom kinds among themselves."""
    return F.when(kind.isin(*known), F.lit("")).otherwise(kind)


def confidence_rank(confidence: Column) -> Column:
    """4 for exact down to 1 for low."""
    return F.lit(len(CONFIDENCES)) - rank(confidence, CONFIDENCES)
