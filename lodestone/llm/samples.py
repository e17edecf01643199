"""Bounded samples of labelled rows for fitting models, and the split that keeps held-out rows out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.scratch import drop, materialize

from .common import held_out

MOST_CLASSES = 2000
MOST_BYTES = 48 << 20  # text of a sample at most


def sample_ids(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label) of about ``per_class`` rows of each class, those of lowest hash; never a held-out row.

    Classes are counted first, so the share to keep is known and no class is gathered in one task. Rows without id or
    label are left out. Every class has a row at least; beyond 200 classes each has fewer, so that the sample stays
    bounded, and beyond ``MOST_CLASSES`` there is an error.
    """
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("label").agg(F.count("*"), F.min(unit)).limit(MOST_CLASSES + 1).collect()
    if not counts:
        return rows.limit(0)
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes in {label}")
    per_class = max(1, min(per_class, 200 * per_class // len(counts)))
    kind = StructType([StructField("label", rows.schema["label"].dataType), StructField("share", DoubleType()), StructField("least", DoubleType())])
    shares = rows.sparkSession.createDataFrame([(value, min(1.0, per_class / n), least) for value, n, least in counts], kind)
    return rows.join(F.broadcast(shares), "label").where((unit < F.col("share")) | (unit == F.col("least"))).select("doc_id", "label")


def within(rows: DataFrame, label: str, most_bytes: int) -> DataFrame:
    """Of a bounded number of rows, as many whole texts as fit into ``most_bytes``, the same share for each class; of every
    class one at least. Texts larger than a class's share come last."""
    size = F.octet_length("text")
    if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes:
        return rows
    share = most_bytes // max(1, rows.select(label).distinct().count())
    w = Window.partitionBy(label).orderBy(size > share, F.xxhash64("doc_id", F.lit("size")), "doc_id", "text")
    ranked = rows.withColumns({"_at": F.row_number().over(w), "_sum": F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return ranked.where(f"_at = 1 or _sum <= {share}").select(*rows.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = MOST_BYTES) -> list[tuple[int, str, object]]:
    """[(doc_id, text, label)] of the sample, whole texts, in the order of doc_id. The ids are a bounded number of rows and are
    broadcast; the texts are written, and no more than ``most_bytes`` of them are gathered."""
    ids = sample_ids(labels, label, per_class).dropDuplicates(["doc_id"])
    rows = materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "sample")
    got = within(rows, "label", most_bytes).collect()
    drop(rows)
    return sorted((r[0], r[1], r[2]) for r in got)
