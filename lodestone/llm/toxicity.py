"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (n in ``ORDERS``, ASCII-folded text, hashed into ``2**BITS`` cells per n).
Fitting counts the documents of each class that have it, scales it by the log ratio r of the smoothed class
frequencies, keeps the cells seen in ``MIN_DOCS`` documents with a ratio of ``RATIO`` at least, and fits weights by
logistic regression with an L2 penalty on the scaled features. Scoring sums weight times ratio over a text's distinct cells,
in Arrow batches over whole texts. The settings were chosen by cross-validation on rows that aren't held out.

Sample: about ``PER_CLASS`` rows a label, whole texts, ``samples.MOST_BYTES`` together (the bounds). Edge cases: null and
empty texts have no feature and get the score of the intercept; repeated rows and ties score alike, a null doc_id is scored
like any other; empty tables give no rows; other columns are ignored; without labelled rows of both kinds the score is the
share of label 1 (0 without any); labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, tune_arrow
from .samples import labelled_texts

ORDERS, BITS, PER_CLASS = (3, 4, 5, 6), 18, 1500
MIN_DOCS, ALPHA, PENALTY, STEPS = 6, 1.0, 3.0, 300
RATIO = 2.0  # least log-count ratio of a feature, either way
_A = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and their offsets; A-Z folded, a space before and after each text."""
    parts = [" " + (t or "") + " " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    upper = (code >= 65) & (code <= 90)
    code[upper] += 32
    return code, np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _cells(code: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(code) - n + 1), n * 0x61C88647 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            h ^= code[j : len(code) - n + 1 + j] * _A[j]
            h = (h << np.uint32(7)) | (h >> np.uint32(25))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(texts: list[str | None], use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct cells of each text, of those in ``use`` if given."""
    code, off = _codes(texts)
    rows, cells = [], []
    last = np.zeros(len(ORDERS) << BITS, np.int64)
    for k, n in enumerate(ORDERS):
        c = _cells(code, n) + (k << BITS)
        at = np.arange(len(c))
        row = np.searchsorted(off, at, "right") - 1
        ok = at + n <= off[1:][row]
        if use is not None:
            ok &= use[c]
        c, row = c[ok], row[ok]
        # of equal cells in a row the last written place is the one that counts, row by row
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            part = c[edge[i] : edge[i + 1]]
            place = np.arange(len(part))
            last[part] = place
            part = part[last[part] == place]
            cells.append(part)
            rows.append(np.full(len(part), i))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class NaiveBayesLinear:
    """Per cell the weight times the log-count ratio, and an intercept."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.cell = np.flatnonzero(weight).astype(np.int32)
        self.value, self.bias = weight[self.cell].astype(np.float32), bias

    @classmethod
    def fit(cls, texts: list[str], y: list[int]) -> NaiveBayesLinear:
        y = np.asarray(y, np.float64)
        size = len(ORDERS) << BITS
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(size), float(np.log((y.sum() + 1e-3) / (len(y) - y.sum() + 1e-3))) if len(y) else -20.0)
        parts = [slice(k, k + 200) for k in range(0, len(texts), 200)]
        n1, n0 = np.zeros(size), np.zeros(size)
        for part in parts:
            row, cell = features(texts[part])
            n1 += np.bincount(cell, y[part][row], size)
            n0 += np.bincount(cell, 1 - y[part][row], size)
        seen = n1 + n0 >= MIN_DOCS
        r = np.where(seen, np.log((n1 + ALPHA) / (y.sum() + 2 * ALPHA)) - np.log((n0 + ALPHA) / ((1 - y).sum() + 2 * ALPHA)), 0.0)
        told = seen & (np.abs(r) > RATIO)
        use = np.flatnonzero(told)
        number = np.full(size, -1, np.int32)
        number[use] = np.arange(len(use))
        rows, cols = [], []
        for part in parts:
            row, cell = features(texts[part], told)
            rows.append((row + part.start).astype(np.int32))
            cols.append(number[cell])
        row, col = np.concatenate(rows), np.concatenate(cols)
        x = r[use].astype(np.float32)[col]
        w, b = np.zeros(len(use)), 0.0
        m, v = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], len(y)) + b, -30, 30)))
            g = (p - y) / len(y)
            grad = np.append(np.bincount(col, x * g[row], len(use)) + PENALTY * w / len(y), g.sum())
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        weight = np.zeros(size)
        weight[use] = w * r[use]
        return cls(weight, b)

    def shift(self, prior: float, sampled: float) -> None:
        """Moves the intercept from the sample's share of label 1 to the corpus's."""
        if 0 < prior < 1 and 0 < sampled < 1:
            self.bias += float(np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))

    def table(self) -> np.ndarray:
        t = np.zeros(len(ORDERS) << BITS, np.float32)
        t[self.cell] = self.value
        return t

    def score(self, texts: list[str | None], table_: np.ndarray) -> np.ndarray:
        row, cell = features(texts, table_ != 0)
        s = np.bincount(row, table_[cell], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> NaiveBayesLinear:
    rows = labelled_texts(docs, labels, label, per_class)
    y = [int(r[2]) for r in rows]
    model = NaiveBayesLinear.fit([r[1] for r in rows], y)
    if y and 0 < sum(y) < len(y):
        share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
        model.shift(share, sum(y) / len(y))
    return model


def score(docs: DataFrame, model: NaiveBayesLinear) -> DataFrame:
    """doc_id and score of every row."""
    tune_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        t = m.table()
        for rows in slices(batches, limit=500_000):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(m.score(rows.column("text").to_pylist(), t), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
