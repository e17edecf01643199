"""The older {nodes, links} form, as column expressions over its JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.graph import EvidenceGraph
from lodestone.schema import EVIDENCE_KINDS

_POINT = "struct<line:bigint,character:bigint>"
_NODE = f"struct<id:string,label:string,kind:string,type:string,language:string,source_file:string,source_range:struct<start:{_POINT},end:{_POINT}>,selection_start:{_POINT},selection_end:{_POINT}>"
_LINK = "struct<source:string,target:string,relation:string,kind:string,type:string,confidence:string,provenance:string,line:bigint,character:bigint,compileOnly:boolean,typeOnly:boolean,specifier:string,usage:string>"
_NODE_FIELDS = ("id", "label", "kind", "type", "language", "source_range")
_LINK_FIELDS = ("source", "target", "relation", "kind", "type", "confidence", "provenance")
_TRIMMED = r"^\S(?s:.*\S)?$"


def _position(p: Column) -> Column:
    return F.struct((p["line"] + 1).alias("line"), (p["character"] + 1).alias("column"))



@F.pandas_udf(T.StringType())
def _without(raw, taken):
    import json

    import pandas as pd

    known = ("source_file", "selection_start", "selection_end", "line", "character", "compileOnly", "typeOnly", "specifier", "usage")
    out = []
    for text, names in zip(raw, taken, strict=True):
        drop = set(names.split(","))
        d = {k: v for k, v in json.loads(text).items() if k not in drop and not (v is None and k in known)}
        out.append(json.dumps(d, ensure_ascii=False) if d else None)
    return pd.Series(out)


def from_legacy(text: DataFrame, extractor: str = "legacy", column: str = "value") -> EvidenceGraph:
    """Of rows that each hold a document {nodes, links}; other fields of the document are ignored."""
    doc = text.select(F.from_json(column, "struct<nodes:array<string>,links:array<string>>").alias("d"))
    n = doc.select(F.explode("d.nodes").alias("raw")).withColumn("v", F.from_json("raw", _NODE))
    v = F.col("v")
    named = F.coalesce(v["kind"], v["type"])
    kind = F.when(F.coalesce(named.rlike(_TRIMMED), F.lit(False)), named).when(v["id"].contains("#"), "function").otherwise("file")
    span = F.when(v["source_range"].isNotNull() & v["source_file"].isNotNull(), F.struct(v["source_file"].alias("file"), _position(v["source_range"]["start"]).alias("start"), _position(v["source_range"]["end"]).alias("end")))
    nodes = n.select(v["id"].alias("id"), F.coalesce(v["label"], F.regexp_extract(v["id"], r"([^/#]*)$", 1)).alias("label"), kind.alias("kind"), v["language"].alias("language"), span.alias("span"), _without("raw", F.lit(",".join(_NODE_FIELDS))).alias("attributes"))

    e = doc.select(F.explode("d.links").alias("raw")).withColumn("v", F.from_json("raw", _LINK))
    said = F.coalesce(v["provenance"], v["confidence"])
    evidence = F.when(F.coalesce(said.rlike(_TRIMMED), F.lit(False)), said).otherwise(EVIDENCE_KINDS[1])
    level = F.lower(F.trim(F.coalesce(v["confidence"], F.lit(""))))
    confidence = F.when(level.isin("exact", "exact_lsp"), "exact").when(level.isin("high", "extracted", "resolved"), "high").when(level == "medium", "medium").when(level.isin("low", "inferred", "conflict"), "low").when(evidence == "EXACT_LSP", "exact").when(evidence.isin("INFERRED", "CONFLICT"), "low").otherwise("high")
    column_ = F.coalesce(v["character"], F.lit(0)) + 1
    at = F.when(v["line"].isNotNull(), F.struct(F.substring_index(v["source"], "#", 1).alias("file"), F.struct(v["line"].alias("line"), column_.alias("column")).alias("start"), F.struct(v["line"].alias("line"), (column_ + 1).alias("column")).alias("end")))
    provenance = F.struct(F.lit(extractor).alias("extractor"), evidence.alias("evidence"), confidence.alias("confidence"), at.alias("span"), F.lit(None).cast("string").alias("detail"))
    edges = e.select(v["source"].alias("source"), v["target"].alias("target"), F.coalesce(v["relation"], v["kind"], v["type"], F.lit("references")).alias("kind"), provenance.alias("provenance"), _without("raw", F.lit(",".join(_LINK_FIELDS))).alias("attributes"))
    return EvidenceGraph.from_parts(nodes, edges)
