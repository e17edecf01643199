"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from lodestone.llm.common import rows_of_their_own, table
from lodestone.scratch import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or null) go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows without an id or with another's are rows of their own, null
    ids below all others."""
    named, less = rows_of_their_own(docs, nulls_last=False)
    return less(exact_dedup.exact_dedup(named, exact_dedup.snapshot_half(F.col("doc_id"))).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays; as in ``exact``, but null ids are above all others."""
    named, less = rows_of_their_own(docs, nulls_last=True)
    return less(ngram_join.near_duplicates(named).where("component_id <> doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Neural language identification and tokenisation have no SQL; tests/llm compares the pipeline with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
