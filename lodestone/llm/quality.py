"""Quality: a compression classifier.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is compressed in
blocks with each of them; the difference of the compressed sizes over the text's size (above 0: the good dictionary
fits better) is turned into a probability by logistic calibration on labelled rows that were not used for the dictionaries. Short texts are
little evidence: below some hundred bytes the logit moves towards that of the corpus's share of label 1.
Scoring runs in Arrow batches over whole texts.

Sample: about ``PER_CLASS`` rows a label, whole texts, ``samples.MOST_BYTES`` together (the bounds), half for the
dictionaries and half for the calibration, which is weighted to the labels' shares in the corpus. Edge cases: null and empty
texts get the corpus's share of label 1; repeated rows score alike, a null doc_id is scored like any other; empty tables give
no rows; other columns are ignored; without labelled rows of both kinds the score is the share of label 1 (0.5 without any); labels, lang, source
and doc_id are not inputs of a score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, tune_arrow, utf8
from .samples import labelled_texts

DICTIONARY, BLOCK, LEVEL, PER_CLASS = 112_640, 4096, 3, 1500
LITTLE = 60  # bytes whose logit counts half
_PIECE = 1024  # bytes of a dictionary's training piece


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    pieces = [b[k : k + _PIECE] for b in (t.encode() for t in texts) for k in range(0, len(b), _PIECE)]
    total = sum(map(len, pieces))
    # the trainer wants many times the dictionary's size; small samples get a smaller or plain-content dictionary
    try:
        return zstandard.train_dictionary(max(1024, min(size, total // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class CompressionClassifier:
    def __init__(self, good: bytes, bad: bytes, prior: float, slope: float = 0.0, bias: float | None = None):
        self.good, self.bad, self.slope = good, bad, slope
        self.prior = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
        self.bias = self.prior if bias is None else bias

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]

    @staticmethod
    def difference(text: memoryview, both) -> float:
        """(bad - good) / size of the compressed sizes over all blocks."""
        if not len(text):
            return 0.0
        good = bad = 0
        for k in range(0, len(text), BLOCK):
            part = text[k : k + BLOCK]
            good += len(both[0].compress(part))
            bad += len(both[1].compress(part))
        return (bad - good) / len(text)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of y on x by Newton steps with a little ridge."""
        a = np.stack([x, np.ones_like(x)], axis=1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (weight * (p - y)) + 1e-3 * w
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.bias = float(w[0]), float(w[1])

    def probability(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        told = size / (size + LITTLE)
        return 1 / (1 + np.exp(-np.clip(told * (self.slope * x + self.bias) + (1 - told) * self.prior, -40, 40)))


def train(texts: list[str], y: list[int], share: float, key: list[int]) -> CompressionClassifier:
    """``key`` divides the rows between dictionaries and calibration; ``share``: the corpus's share of label 1."""
    half = [zlib.crc32(f"half {k}".encode()) % 2 for k in key]
    pick = lambda h, v: [t for t, l, x in zip(texts, y, half, strict=True) if x == h and l == v and t]
    if not all(pick(h, v) for h in (0, 1) for v in (0, 1)):
        return CompressionClassifier(b"good", b"bad", share)
    model = CompressionClassifier(build_dictionary(pick(0, 1)), build_dictionary(pick(0, 0)), share)
    both = model.compressors()
    x, t = [], []
    for v in (0, 1):
        for text in pick(1, v):
            x.append(model.difference(memoryview(text.encode()), both))
            t.append(v)
    x, t = np.array(x), np.array(t, float)
    model.calibrate(x, t, np.where(t == 1, share / max(1e-9, t.mean()), (1 - share) / max(1e-9, 1 - t.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> CompressionClassifier:
    rows = labelled_texts(docs, labels, label, per_class)
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train([r[1] for r in rows], [int(r[2]) for r in rows], 0.5 if share is None else share, [r[0] for r in rows])


def score(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """doc_id, score and difference of every row."""
    tune_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        both = shared.value.compressors()
        for rows in slices(batches):
            data, off = utf8(rows.column("text"))
            view, at = memoryview(data), off.tolist()
            x = np.array([shared.value.difference(view[at[k] : at[k + 1]], both) for k in range(rows.num_rows)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.probability(x, np.diff(off)), pa.float64()), pa.array(x, pa.float64())], names=["doc_id", "score", "difference"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double, difference double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
