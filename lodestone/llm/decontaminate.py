"""Benchmark decontamination with suffix arrays over the training documents.

Each Arrow slice of documents (about 2 MB of text, whole documents) is one shard: its words become 64-bit
hashes, prefix doubling sorts all word suffixes (a document's end sorts below every word and differs from
every test word, so no match crosses it), and every benchmark suffix is looked up by binary search, all of
them at once. The range of suffixes that share a test suffix's first ``window`` words gives every location, and each
of these is extended word by word to the longest verbatim match there. Nothing is shuffled; the benchmark is broadcast in
blocks of a bounded number of words, one pass over the documents per block.

Edge cases: a null or wordless text has no words and is clean; an item without words matches nothing; an item of fewer words
than the window is one window; rows of one item_id are one item, a null item_id is an item, too; repeated rows are scored
alike, and rows are told apart by more than their doc_id, which may be null; of equally long matches the smallest item_id is
named; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import materialize

from .common import BYTE_ALNUM, slices, table, tune_arrow, utf8, words

WINDOW = 10
BLOCK_BYTES = 32_000_000  # text of the items in one broadcast block at most (a longer item is a block of its own)


class TestSuffixes:
    """The words of a block of benchmark items and the suffixes that start a window."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int):
        data, off = utf8(pa.array([t or "" for t in texts], pa.large_string()))
        self.words, item, _, _ = words(data, off, BYTE_ALNUM)
        self.ids = np.array(ids, object)  # None is an item too
        n = np.bincount(item, minlength=len(ids))
        start = np.concatenate([[0], np.cumsum(n)])
        self.at, self.item, self.depth = [], [], []
        for k in np.flatnonzero(n).tolist():
            count = max(1, n[k] - window + 1)
            self.at.append(start[k] + np.arange(count))
            self.item.append(np.full(count, k))
            self.depth.append(np.full(count, min(window, n[k])))
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        self.at, self.item, self.depth = cat(self.at), cat(self.item), cat(self.depth)
        self.end = start[1:][self.item] if len(self.item) else self.item
        self.longest = int(n.max()) if len(n) else 0


def suffix_array(w: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``w`` in the order of the suffixes that start there, compared over ``depth`` words at least or
    until all differ. ``ends``: True at positions that end a document; they sort below words, each by its place."""
    n = len(w)
    sa = np.argsort(np.where(ends, np.uint64(0), w), kind="stable")
    key = w[sa]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (key[1:] != key[:-1]) | ends[sa[1:]] | ends[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while step < depth:
        # only suffixes still tied are sorted again
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        at = sa[where]
        nxt = at + step
        key = rank[at] * np.int64(n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[where] = at
        first = np.empty(len(where), bool)
        first[:1] = True
        first[1:] = key[1:] != key[:-1]
        new[where] = first
        rank[at] = np.maximum.accumulate(np.where(first, where, 0))
        step *= 2
    return sa


def _order(w: np.ndarray, pos: np.ndarray, q: np.ndarray, at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the suffix of ``w`` at ``pos`` against the words ``q`` from ``at``, over ``upto`` words."""
    out = np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    k = 0
    while len(live):
        live = live[k < upto[live]]
        a, b = w[np.minimum(pos[live] + k, len(w) - 1)], q[at[live] + k]
        out[live] = np.where(a < b, -1, np.where(a > b, 1, 0))
        live = live[a == b]
        k += 1
    return out


def _bound(w, sa, q, at, upto, right: bool) -> np.ndarray:
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        c = _order(w, sa[mid], q, at[open_], upto[open_])
        go = c <= 0 if right else c < 0
        lo[open_[go]] = mid[go] + 1
        hi[open_[~go]] = mid[~go]


def search(data: np.ndarray, off: np.ndarray, test: TestSuffixes) -> tuple:
    """n_words per document, and the matches: document, item, first word there, first word in the suffix list, words,
    and whether it is the longest that the suffix has in the shard; word starts and ends as bytes last."""
    w, doc, starts, ends = words(data, off, BYTE_ALNUM)
    n_words = np.bincount(doc, minlength=len(off) - 1)
    none = np.empty(0, np.int64)
    if not len(w) or not len(test.at):
        return n_words, none, none, none, none, starts, ends, w, doc
    q = test.words
    w = np.where(w == 0, np.uint64(1), w)
    # one closing word per document, 0, which no test word equals
    place = np.arange(len(w)) + doc
    full = np.zeros(len(w) + len(off) - 1, np.uint64)
    full[place] = w
    closing = np.ones(len(full), bool)
    closing[place] = False
    back = np.full(len(full), -1, np.int64)
    back[place] = np.arange(len(w))
    known = np.isin(full, q)  # suffixes that start with a word of no test can't match and need no sorting
    sa = suffix_array(full, closing, max(test.longest, 1))
    sa = sa[known[sa]]
    if not len(sa):
        return n_words, none, none, none, none, starts, ends, w, doc
    lo = _bound(full, sa, q, test.at, test.depth, False)
    hi = _bound(full, sa, q, test.at, test.depth, True)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    pos = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else none
    return n_words, back[pos], which, doc[back[pos]], test.item[which], starts, ends, w, doc


def extend(w: np.ndarray, doc: np.ndarray, pos: np.ndarray, test: TestSuffixes, which: np.ndarray) -> np.ndarray:
    """Words that the documents from ``pos`` and the test suffixes ``which`` share."""
    n = test.depth[which].copy()
    live = np.arange(len(pos))
    while len(live):
        p, q = pos[live] + n[live], test.at[which[live]] + n[live]
        ok = (p < len(w)) & (q < test.end[which[live]])
        live, p, q = live[ok], p[ok], q[ok]
        same = (w[p] == test.words[q]) & (doc[p] == doc[pos[live]])
        live = live[same]
        n[live] += 1
    return n


def _blocks(bench: DataFrame, window: int) -> list:
    """The benchmark in broadcast blocks; its total size is checked before anything is collected, and the driver holds one
    block at a time."""
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    part = bench.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("b"))
    if n > 1:  # sorted by block, so that reading one skips the others' row groups
        part = materialize(part.repartitionByRange(n, "b").sortWithinPartitions("b"), "blocks")
    out = []
    for b in range(n):
        rows = part.where(F.col("b") == b).select("item_id", "text").collect()
        out.append(bench.sparkSession.sparkContext.broadcast(TestSuffixes([r[0] for r in rows], [r[1] for r in rows], window)))
    return out


def _null_last(x: int | None) -> tuple:
    return x is None, x or 0


SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, longest long, longest_item long, hits array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: words, words hit, items found, the longest verbatim match with its item, and the hit
    passages as byte spans of the UTF-8 text (end exclusive)."""
    spark = docs.sparkSession
    tune_arrow(spark)
    blocks = _blocks(bench, window)

    def one(shared):
        def find(batches):
            test = shared.value
            for rows in slices(batches):
                data, off = utf8(rows.column("text"))
                n_words, pos, which, doc, item, starts, ends, w, word_doc = search(data, off, test)
                n_docs = len(n_words)
                got: dict = {}
                if len(pos):
                    size = extend(w, word_doc, pos, test, which)
                    depth = test.depth[which]
                    mark = np.zeros(len(w) + 1, np.int64)
                    np.add.at(mark, pos, 1)
                    np.add.at(mark, pos + depth, -1)
                    hit = np.cumsum(mark[:-1]) > 0
                    n_hit = np.bincount(word_doc[hit], minlength=n_docs)
                    head = hit.copy()
                    head[1:] &= ~hit[:-1] | (word_doc[1:] != word_doc[:-1])
                    tail = hit.copy()
                    tail[:-1] &= ~hit[1:] | (word_doc[1:] != word_doc[:-1])
                    spans: dict = {}
                    for d, s, e in zip(word_doc[head].tolist(), (starts[head] - off[word_doc[head]]).tolist(), (ends[tail] - off[word_doc[tail]]).tolist(), strict=True):
                        spans.setdefault(d, []).append({"start": s, "end": e})
                    order = np.lexsort((item, -size, doc))
                    d, i = doc[order], item[order]
                    first = np.concatenate([[True], d[1:] != d[:-1]])
                    top = dict(zip(d[first].tolist(), zip(size[order][first].tolist(), test.ids[i[first]].tolist(), strict=True), strict=True))
                    both = np.unique(np.stack([doc, item]), axis=1)
                    for d, i in both.T.tolist():
                        got.setdefault(d, []).append(test.ids[i])
                else:
                    n_hit, top, spans = np.zeros(n_docs, np.int64), {}, {}
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(set(got.get(k, ())), key=_null_last) for k in range(n_docs)], pa.list_(pa.int64())),
                     pa.array([top.get(k, (0, None))[0] for k in range(n_docs)], pa.int64()), pa.array([top.get(k, (0, None))[1] for k in range(n_docs)], pa.int64()),
                     pa.array([spans.get(k, []) for k in range(n_docs)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "item_ids", "longest", "longest_item", "hits"])

        return find

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(blocks) == 1:
        return docs.mapInArrow(one(blocks[0]), SCHEMA)
    # Several blocks: hit passages of the same row are united over the blocks, by a key that null and repeated ids don't share.
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    ids = docs.select("row", "doc_id")
    docs = docs.select(F.col("row").alias("doc_id"), "text")
    each = [docs.mapInArrow(one(b), SCHEMA) for b in blocks]
    found = each[0]
    for p in each[1:]:
        found = found.unionByName(p.where("n_hit > 0"))

    def unite(key, pdf):
        import pandas as pd

        spans: list = []
        for s, e in sorted((x["start"], x["end"]) for h in pdf["hits"] for x in h):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        return pd.DataFrame({"doc_id": [key[0]], "hits": [[{"start": s, "end": e} for s, e in spans]]})

    hits = found.where("n_hit > 0").select("doc_id", "hits")
    many = hits.groupBy("doc_id").applyInPandas(unite, "doc_id long, hits array<struct<start:long,end:long>>")
    best = F.min(F.struct((-F.col("longest")).alias("size"), F.col("longest_item").isNull().alias("last"), F.col("longest_item").alias("item")))
    items = found.where("n_hit > 0").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("best"))
    many = many.join(items.select("doc_id", "item_ids", (-F.col("best.size")).alias("longest"), F.col("best.item").alias("longest_item")), "doc_id")
    base = each[0].select("doc_id", "n_words")
    out = base.join(many, "doc_id", "left")
    texts = docs.join(many.select("doc_id", F.col("hits").alias("h")), "doc_id")
    words_in = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.size(F.regexp_extract_all(F.decode(F.substring(F.encode("text", "UTF-8"), (x.start + 1).cast("int"), (x.end - x.start).cast("int")), "UTF-8"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)))
    hit = texts.groupBy("doc_id").agg(F.max(words_in).alias("n_hit"))
    out = out.withColumnRenamed("doc_id", "row").join(hit.withColumnRenamed("doc_id", "row"), "row", "left").join(ids, "row")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), "longest_item", F.coalesce("hits", F.array().cast("array<struct<start:long,end:long>>")).alias("hits"))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, in all their columns."""
    tune_arrow(docs.sparkSession)

    def rid(shared):
        def keep(batches):
            for rows in slices(batches):
                data, off = utf8(rows.column("text"))
                clean = np.ones(rows.num_rows, bool)
                clean[search(data, off, shared.value)[3]] = False
                yield rows.filter(pa.array(clean))

        return keep

    blocks = _blocks(bench, window)
    for k, block in enumerate(blocks):  # row by row: neither null nor repeated ids matter
        docs = docs.mapInArrow(rid(block), docs.schema)
        if k + 1 < len(blocks):
            docs = materialize(docs, "clean")
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""
