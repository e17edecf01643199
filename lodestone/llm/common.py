"""What the text operators share: table access, Arrow slices and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.loop import number_rows
from lodestone.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 2_000_000
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def without(docs: DataFrame, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids``; ids are broadcast only if they are ``most`` at most."""
    ids = materialize(ids.select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_anti").select(*docs.columns)


def identified(docs: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``docs`` with ids of their own, above all others, for rows without one, and the way back: such ids are null again."""
    if docs.where("doc_id is null").isEmpty():
        return docs, lambda c: c
    far = F.lit(1 << 62)
    own = far + F.monotonically_increasing_id()
    return materialize(docs.select(F.coalesce("doc_id", own).alias("doc_id"), "text"), "identified"), lambda c: F.when(c < far, c)


def rows_of_their_own(docs: DataFrame, nulls_last: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, text) with unique doc_ids in the order of those of ``docs``, and a function that gives back ``docs`` less the
    rows whose doc_id here is in a table. Where ids are unique already, they are taken as they are."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, lambda dropped: without(docs, dropped)
    whole = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    order = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    rows = materialize(number_rows(whole, [order], "row").select(F.col("row").alias("doc_id"), "text", "whole"), "rows")
    return rows.select("doc_id", "text"), lambda dropped: without(rows, dropped).select("whole.*")


SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` bytes of text; one row is never divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(column))[1])
        at, start, total = 0, 0, 0
        for at, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        yield batch.slice(start, batch.num_rows - start)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[0] == off[-1]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _G)


BYTE_SPACE = np.ones(256, bool)
BYTE_SPACE[[0x20, *range(9, 14)]] = False
BYTE_ALNUM = np.zeros(256, bool)
BYTE_ALNUM[0x30:0x3A] = BYTE_ALNUM[0x61:0x7B] = BYTE_ALNUM[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BYTE = stream(7, 256) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of folded bytes: word hashes (uint64), each word's row, and its first and past-last byte. Words end with their row."""
    folded = FOLD[data]
    inside = is_word[folded]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    longest = int((ends - starts).max())
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(longest, _STEP, np.uint64))
        at = 0
        while at < len(starts):  # blocks of some MB, cut between words
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 4_000_000, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            begin = np.zeros(hi - lo, np.int64)
            begin[starts[at:to] - lo] = starts[at:to] - lo
            pos = np.arange(hi - lo) - np.maximum.accumulate(begin)
            value = _BYTE[folded[lo:hi]] * power[np.minimum(pos, longest - 1)]
            value[~inside[lo:hi]] = 0
            hashes[at:to] = np.add.reduceat(value, starts[at:to] - lo)
            at = to
        hashes = mix(hashes)
    return hashes, np.searchsorted(off, starts, "right") - 1, starts, ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
