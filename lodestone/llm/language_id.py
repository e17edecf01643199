"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions (a gated recurrent unit each way), labels every byte
from the two states at it, and a document's probabilities are the mean of its bytes' log-probabilities over all of
its windows, softmaxed. It is written in numpy and trained by backpropagation through time with Adam, on the driver,
on random windows of a bounded sample of labelled rows; scoring runs in Arrow batches over whole texts.

Sample: about ``PER_CLASS`` rows per language, beyond 200 languages as many fewer, whole texts, ``samples.MOST_BYTES``
together (the bounds); all languages found are learned, and more than ``samples.MOST_CLASSES`` are an error.

Edge cases: null, empty and letterless texts are ``und`` with score 0; repeated rows score alike, a null doc_id is scored
like any other; of equal probabilities the first language in the alphabet is taken; empty tables give no rows; other columns
are ignored; without a labelled row every text is ``und``; lang, source and doc_id are not inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tune_arrow, utf8
from .samples import labelled_texts

WINDOW, HIDDEN, PER_CLASS = 64, 8, 400
STEPS, BATCH, RATE = 500, 192, 0.015
LANES = 4096  # windows scored side by side
_LETTER = regex.compile(r"\p{L}")


def _glorot(rng, a, b):
    return (rng.standard_normal((a, b)) * np.sqrt(2.0 / (a + b))).astype(np.float32)


class ByteGRU:
    """Two gated recurrent units over bytes and a softmax at every position.

    Per direction: gates [r z] = sigmoid(E[x] + h U), candidate c = tanh(F[x] + r * (h V)), h' = c + z (h - c). The
    input projections are tables by byte. Sigmoids are computed as (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        k = len(classes)
        self.p = {}
        for d in "fb":
            self.p["E" + d] = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
            self.p["U" + d] = np.concatenate([_glorot(rng, hidden, hidden) for _ in range(3)], axis=1)
        self.p["W"] = _glorot(rng, 2 * hidden, k)
        self.p["b"] = np.zeros(k, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States (T, B, H) over x (T, B); with ``keep`` also what the backward pass needs."""
        h_size, e, u = self.hidden, self.p["E" + d], self.p["U" + d]
        steps, n = x.shape
        h = np.zeros((n, h_size), np.float32)
        out = np.empty((steps, n, h_size), np.float32)
        saved = []
        a = np.empty((n, 3 * h_size), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = e[x[t]]
            np.matmul(h, u, out=a)
            rz = g[:, : 2 * h_size]
            rz += a[:, : 2 * h_size]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            r, z, v = rz[:, :h_size], rz[:, h_size:], a[:, 2 * h_size :]
            c = r * v
            c += g[:, 2 * h_size :]
            np.tanh(c, out=c)
            if keep:
                saved.append((t, h, r, z, v.copy(), c))
            h = c + z * (h - c)
            out[t] = h
        return out, saved

    def log_probs(self, x: np.ndarray, keep: bool = False):
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        logits = f @ self.p["W"][: self.hidden] + b @ self.p["W"][self.hidden :] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logits, f, b, sf, sb

    def _scan(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (T, H, B) as of ``_run``, with the windows along the last axis so that each step is long vector operations."""
        h_size = self.hidden
        e, u = np.ascontiguousarray(self.p["E" + d].T), np.ascontiguousarray(self.p["U" + d].T)
        e[: 2 * h_size] *= 0.5
        u[: 2 * h_size] *= 0.5
        steps, n = x.shape
        h, c = np.zeros((h_size, n), np.float32), np.empty((h_size, n), np.float32)
        g, a, out = np.empty((3 * h_size, n), np.float32), np.empty((3 * h_size, n), np.float32), np.empty((steps, h_size, n), np.float32)
        rz = g[: 2 * h_size]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(e, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            rz += a[: 2 * h_size]
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            np.multiply(rz[:h_size], a[2 * h_size :], out=c)
            c += g[2 * h_size :]
            np.tanh(c, out=c)
            h = h - c
            h *= rz[h_size:]
            h += c
            out[t] = h
        return out

    def position_log_probs(self, x: np.ndarray) -> np.ndarray:
        """(T, classes, B) over x (T, B): every byte's label."""
        w = np.ascontiguousarray(self.p["W"].T)
        lp = np.matmul(np.ascontiguousarray(w[:, : self.hidden]), self._scan(x, "f"))
        lp += np.matmul(np.ascontiguousarray(w[:, self.hidden :]), self._scan(x, "b"))
        lp += self.p["b"][:, None]
        lp -= lp.max(axis=1, keepdims=True)
        lp -= np.log(np.exp(lp).sum(axis=1, keepdims=True))
        return lp

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all bytes (256 pads) and its gradients, back through time. x (T, B), y (B,)."""
        h_size = self.hidden
        lp, f, b, sf, sb = self.log_probs(x, True)
        real = (x != 256).astype(np.float32)
        total = max(1.0, float(real.sum()))
        one = np.eye(len(self.classes), dtype=np.float32)[y]
        loss = -float((lp * one[None] * real[..., None]).sum()) / total
        dl = (np.exp(lp) - one[None]) * (real / total)[..., None]
        grads = {"b": dl.sum((0, 1)), "W": np.concatenate([np.tensordot(f, dl, ([0, 1], [0, 1])), np.tensordot(b, dl, ([0, 1], [0, 1]))])}
        for d, saved, w in (("f", sf, self.p["W"][:h_size]), ("b", sb, self.p["W"][h_size:])):
            dout = dl @ w.T
            u = self.p["U" + d]
            de, du = np.zeros_like(self.p["E" + d]), np.zeros_like(u)
            dh = np.zeros_like(dout[0])
            for t, h, r, z, v, c in reversed(saved):
                dh = dh + dout[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * v * r * (1 - r)
                da = np.concatenate([dr, dz, dc], axis=1)
                np.add.at(de, x[t], da)
                da[:, 2 * h_size :] *= r
                du += h.T @ da
                dh = dh * z + da @ u.T
            grads["E" + d], grads["U" + d] = de, du
        return loss, grads

    def train(self, texts: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, window: int = WINDOW, seed: int = 2) -> list[float]:
        """Adam on random windows, the classes equally often."""
        rng = np.random.default_rng(seed)
        by = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == k and t] for k in range(len(self.classes))]
        have = [k for k, v in enumerate(by) if v]
        m, v, losses = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, []
        for step in range(1, steps + 1):
            x, y = np.full((window, batch), 256, np.int64), np.empty(batch, np.int64)
            for i in range(batch):
                y[i] = have[int(rng.integers(len(have)))]
                t = by[y[i]][int(rng.integers(len(by[y[i]])))]
                at = int(rng.integers(max(1, len(t) - window + 1)))
                part = t[at : at + window]
                x[: len(part), i] = part
            loss, grads = self.gradients(x, y)
            losses.append(loss)
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads.values())))))
            now = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-4
            for k, g in grads.items():
                g = g * scale
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def score(self, data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Summed log-probabilities (rows, classes) over every byte of every row."""
        sizes = np.diff(off)
        n = -(-sizes // window)
        row = np.repeat(np.arange(len(sizes)), n)
        begin = off[:-1][row] + window * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(window, off[1:][row] - begin)
        out = np.zeros((len(sizes), len(self.classes)), np.float64)
        step = np.arange(window)[:, None]
        lanes = max(1, min(LANES, LANES * 200 // len(self.classes)))  # many classes: as much memory
        for k in range(0, len(begin), lanes):
            b, size = begin[k : k + lanes], length[k : k + lanes]
            x = data[np.minimum(b[None] + step, len(data) - 1)].astype(np.intp)
            pad = step >= size[None]
            x[pad] = 256
            lp = self.position_log_probs(x)
            np.multiply(lp, ~pad[:, None], out=lp)
            np.add.at(out, row[k : k + lanes], lp.sum(0).T)
        return out


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> ByteGRU | None:
    rows = labelled_texts(docs, docs, "lang", per_class)
    if not rows:
        return None
    classes = sorted({r[2] for r in rows})
    net = ByteGRU(classes)
    net.train([r[1].encode() for r in rows], [classes.index(r[2]) for r in rows])
    return net


def _predict(rows: pa.RecordBatch, model: ByteGRU | None) -> tuple[list[str], np.ndarray]:
    texts = rows.column("text").to_pylist()
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if model is not None:
        data, off = utf8(rows.column("text"))
        sums = model.score(data, off) if len(data) else np.zeros((len(texts), len(model.classes)))
        size = np.maximum(np.diff(off), 1)[:, None]
        mean = sums / size * np.minimum(size, 40)  # neighbouring bytes are not independent: at most 40 count
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, t in enumerate(texts):
            if t and _LETTER.search(t):
                pred[k], score[k] = model.classes[best[k]], p[k, best[k]]
    return pred, score


def identify(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """doc_id, lang_pred and score (the probability of lang_pred) of every row."""
    tune_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches):
        for rows in slices(batches, limit=1_000_000):
            pred, score = _predict(rows, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """The rows of ``docs``, in all their columns, that have a language; null and letterless texts are rejected, without
    a network too."""
    tune_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches):
        for rows in slices(batches, limit=1_000_000):
            if shared.value is None:
                keep = [bool(t and _LETTER.search(t)) for t in rows.column("text").to_pylist()]
            else:
                keep = [p != "und" for p in _predict(rows, shared.value)[0]]
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
