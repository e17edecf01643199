"""Exact Jaccard self-join on word n-grams, as a blocked sparse product of the document by n-gram incidence.

1. One pass over the texts gives every document's set size and a 128-bit signature of the set, and the n-grams'
   frequencies in hashed counters (an upper bound each, combined over all documents).
2. A second pass emits the incidence of each distinct set with its rarest n-grams only: two sets of similarity t
   share one of the rarest n - ceil(t n) + 1 of each, in any fixed global order; the counters give the order.
3. Columns of the incidence are multiplied in blocks (hash partitions of the n-grams): short columns give their
   pairs with overlap counts, which are summed over the blocks, and pairs below the bound that their sizes imply
   are discarded. A long column gives no pairs: its rows join the group of the column's pivot set, so that a
   cluster of copies forms a few groups however many n-grams it shares.
4. The members of a large group are compared with its pivot first: what links with it is in its component already, so
   only pairs with a member that doesn't are still open. Members are dealt to blocks of bounded size by classes of set
   size, so that blocks whose sizes can't reach the threshold never meet. Each pair of blocks is one dense product over
   the n-grams that at least two of its sets have; it returns a spanning forest of the pairs at or above the threshold.
5. Surviving pairs are checked on the full sets; links are contracted to components.

All of this is exact; no column, group or candidate is capped. Equal sets are one row throughout.

Edge cases: a null, empty or wordless text has the empty set and is linked with nothing; fewer words than n are one
n-gram; repeated rows are equal sets; rows of one doc_id with several texts are several sets; a row without a doc_id is
linked like any other and its id is above all others (so a component of such rows alone has a null name); other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.contract import connected_components
from lodestone.scratch import drop, materialize, shuffle_partitions

from .common import BYTE_SPACE, identified, mix, signed, slices, stream, table, tune_arrow, utf8, words

N, THRESHOLD = 5, 80  # words, per cent
LONG_COLUMN = 16  # sets in a column from which it joins groups instead of giving pairs
HOT_COUNT = 50_000  # counter from which an n-gram's column is a group of its own, dealt by document
BLOCK_SETS, BLOCK_NGRAMS = 1024, 1_000_000  # sets and n-grams in one block of a group
ROWS_IN_PART = 1_000_000  # incidence rows of one task, on average
CHUNK = 1 << 14
FAN_IN = 256  # partial counters added in one task
BROADCAST_IDS = 500_000

_K = stream(11, 64) | np.uint64(1)


def _sets(data: np.ndarray, off: np.ndarray, n: int):
    """Per row, the sorted distinct n-gram hashes of its words."""
    w, doc, _, _ = words(data, off, BYTE_SPACE)
    rows = len(off) - 1
    count = np.bincount(doc, minlength=rows)
    start = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        if len(w) >= n:
            grams = w[: len(w) - n + 1] * _K[0]
            for j in range(1, n):
                grams = grams + w[j : len(w) - n + 1 + j] * _K[j]
            grams = mix(grams)
        else:
            grams = np.empty(0, np.uint64)
        for k in range(rows):
            c = int(count[k])
            if c >= n:
                g = np.sort(grams[start[k] : start[k] + c - n + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])]
            elif c:
                yield mix(np.array([(w[start[k] : start[k] + c] * _K[:c]).sum() + np.uint64(c) * _K[63]], np.uint64))
            else:
                yield grams[:0]


def _signature(g: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(g ^ _K[40]).sum().view(np.int64)), int(mix(g ^ _K[41]).sum().view(np.int64))


def _kept(n: int, per_cent: int) -> int:
    """ceil(t n): the overlap that a set of n n-grams needs at least."""
    return -(-n * per_cent // 100)


def measure(docs: DataFrame, bits: int, n: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2) of the documents, and rows (n, chunk, counts) of each task's counters, n the task's number."""

    def task(batches):
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        empty = None
        for rows in slices(batches):
            sizes, a, b, all_ = [], [], [], []
            for g in _sets(*utf8(rows.column("text")), n):
                s = _signature(g)
                sizes.append(len(g))
                a.append(s[0])
                b.append(s[1])
                all_.append(g)
            counts += np.bincount((np.concatenate(all_) >> shift).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            empty = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), empty.cast(pa.int32()), empty.cast(pa.binary())], names=["doc_id", "n", "s1", "s2", "chunk", "counts"])
        if empty is not None:
            press = zstandard.ZstdCompressor(level=1)
            parts = [press.compress(counts[k : k + CHUNK].tobytes()) for k in range(0, len(counts), CHUNK)]
            none = pa.nulls(len(parts)).cast(pa.int64())
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([none, pa.array([part] * len(parts), pa.int64()), none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "s1", "s2", "chunk", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, s1 long, s2 long, chunk int, counts binary")


def counters(stats: DataFrame, bits: int) -> np.ndarray:
    """The counters summed over all tasks, ``FAN_IN`` at a time: a fixed number of bytes, whatever the input."""
    width = min(CHUNK, 1 << bits)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint64)
        for x in pdf["counts"]:
            out += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes())
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "n": [int(pdf["n"].iloc[0])], "counts": [packed]})

    rows = stats.where("chunk is not null").select("chunk", "n", "counts")
    most = rows.agg(F.max("n")).first()[0] or 0
    while True:
        rows = rows.withColumn("n", F.floor(F.col("n") / FAN_IN).cast("long")).groupBy("chunk", "n").applyInPandas(total, "chunk int, n long, counts binary")
        if most < FAN_IN:
            break
        rows, most = materialize(rows, "counters"), most // FAN_IN
    out = np.zeros(1 << bits, np.uint32)
    for r in rows.collect():
        out[r[0] * width : (r[0] + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r[2]), np.uint32)
    return out


def incidence(docs: DataFrame, shared, bits: int, n: int, per_cent: int) -> DataFrame:
    """(h, key, n): each distinct set's rarest n-grams; n is negative where the column is a group of its own."""

    def task(batches):
        order_of, shift, seen = shared.value, np.uint64(64 - bits), set()
        for rows in slices(batches):
            hs, keys, sizes = [], [], []
            for g in _sets(*utf8(rows.column("text")), n):
                if not len(g) or (s := _signature(g)) in seen:
                    continue
                seen.add(s)
                c = order_of[(g >> shift).astype(np.int64)]
                first = np.argsort(c, kind="stable")[: len(g) - _kept(len(g), per_cent) + 1]
                hs.append(g[first])
                keys.append(np.full(len(first), s[0], np.int64))
                sizes.append(np.where(c[first] >= HOT_COUNT, -len(g), len(g)))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hs))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes).astype(np.int32))], names=["h", "key", "n"])

    return docs.select("text").mapInArrow(task, "h long, key long, n int")


def _short_pairs(key, n, starts, sizes, per_cent):
    """Pairs of the columns of 2 to LONG_COLUMN sets, of sizes that allow the threshold, with their overlap counts."""
    a, b, na, nb = [], [], [], []
    for k in range(2, LONG_COLUMN + 1):
        s = starts[sizes == k]
        if not len(s):
            continue
        i, j = np.triu_indices(k, 1)
        x, y = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
        lo, hi = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
        ok = lo * 100 >= hi * per_cent
        a.append(key[x[ok]])  # keys ascend inside a column
        b.append(key[y[ok]])
        na.append(n[x[ok]])
        nb.append(n[y[ok]])
    if not a or not sum(map(len, a)):
        return None
    a, b, na, nb = map(np.concatenate, (a, b, na, nb))
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], na[first], nb[first], np.diff(np.append(first, len(a)))


def multiply(part: DataFrame, per_cent: int) -> DataFrame:
    """Of incidence rows dealt by column: pairs (a, b, na, nb, c) and, with c = 0, members (group a, set b, size nb)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int32())])

    def out(*cols):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    def task(batches):
        got = []
        for r in batches:
            h, key, n = (r.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            hot = n < 0
            if hot.any():
                yield out(h[hot], key[hot], -n[hot], -n[hot], np.zeros(hot.sum(), np.int32))
            got.append((h[~hot], key[~hot], n[~hot]))
        if not got:
            return
        h, key, n = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(h, kind="stable")
        h = h[order]
        multi = np.zeros(len(h), bool)
        multi[1:] = h[1:] == h[:-1]
        multi[:-1] |= multi[1:].copy()
        h, order = h[multi], order[multi]
        key, n = key[order], n[order]
        if not len(h):
            return
        order = np.lexsort((key, h))
        h, key, n = h[order], key[order], n[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        h, key, n = h[fresh], key[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        if pairs := _short_pairs(key, n, starts, sizes, per_cent):
            for k in range(0, len(pairs[0]), 50_000):
                yield out(*(x[k : k + 50_000] for x in pairs))
        long = sizes > LONG_COLUMN
        if long.any():
            s, z = starts[long], sizes[long]
            at = np.repeat(s, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
            group = np.repeat(key[s], z)  # the pivot: the smallest key of the column
            order = np.lexsort((key[at], group))
            at, group = at[order], group[order]
            first = np.concatenate([[True], (group[1:] != group[:-1]) | (key[at][1:] != key[at][:-1])])
            at, group = at[first], group[first]
            yield out(group, key[at], n[at], n[at], np.zeros(len(at), np.int32))

    return part.mapInArrow(task, "a long, b long, na int, nb int, c int")


def _forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the components of a symmetric boolean matrix."""
    label = np.arange(len(ids))
    while True:
        low = np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _product(pdf: pd.DataFrame, per_cent: int) -> pd.DataFrame:
    """Forest of the links inside a block (i = j), or between the members of block i and those of block j."""
    pdf = pdf.drop_duplicates("key")
    apart = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    pdf = pdf.sort_values("own", kind="stable") if apart else pdf
    cut = int((pdf["own"] == pdf["i"]).sum()) if apart else 0
    ids = pdf["key"].to_numpy(np.int64)
    sets = [np.asarray(x, np.int64) for x in pdf["grams"]]
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count[column] >= 2
    number = np.cumsum(count >= 2) - 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, cut), slice(cut, None)) if apart else (slice(None), slice(None))
    overlap = np.zeros((len(ids[left]), len(ids[right])), np.float32)
    width = 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[lo:hi], column[lo:hi] - c] = 1
        overlap += x[left] @ x[right].T
    inter = overlap.astype(np.int64)
    hit = inter * 100 >= per_cent * (size[left][:, None] + size[right][None, :] - inter)
    if apart:
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[left, right] = hit
        linked |= linked.T
    else:
        linked = hit
    a, b = _forest(linked, ids)
    return pd.DataFrame({"src": a, "dst": b})


def full_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(key, grams) of the documents in ``reps`` (key, doc_id); other texts of the same id are left out."""
    few = reps.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(reps) if few else reps, "doc_id")

    def task(batches):
        for r in slices(batches):
            sets = [*_sets(*utf8(r.column("text")), n)]
            own = np.array([_signature(g)[0] for g in sets], np.int64) == r.column("key").to_numpy(zero_copy_only=False)
            grams = [pa.array(signed(g)) for g, ok in zip(sets, own, strict=True) if ok]
            off = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = pa.concat_arrays(grams) if grams else pa.array([], pa.int64())
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([r.column("key").filter(own), pa.ListArray.from_arrays(pa.array(off), flat)], names=["key", "grams"])

    return rows.select("key", "text").mapInArrow(task, "key long, grams array<long>").dropDuplicates(["key"])


def _checked(pairs: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (src, x, dst, y, ...) with their sets, whether they are linked, as column ``linked``."""
    inter = F.size(F.array_intersect("x", "y"))
    return pairs.withColumn("linked", inter * F.lit(100).cast("long") >= (F.size("x") + F.size("y") - inter) * F.lit(per_cent).cast("long"))


def group_links(groups: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (src, dst) that connect what all links inside the groups (g, key, nb) connect."""
    size = groups.groupBy("g").agg((F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("nb") / BLOCK_NGRAMS)) > 1).alias("large"), F.min("key").alias("pivot"))
    members = groups.join(size, "g")
    # Large groups: members that link with the pivot are in its component; only pairs with one that doesn't are open.
    pivots = sets.select(F.col("key").alias("pivot"), F.col("grams").alias("y"))
    star = members.where("large").join(sets.select("key", F.col("grams").alias("x")), "key").join(pivots, "pivot")
    star = materialize(_checked(star, per_cent).select("g", "key", "nb", "pivot", "linked"), "star")
    step = max(math.log(100 / per_cent) * (1 + 1e-9), 1e-6)  # sizes that can be linked are at most one class apart
    small = members.where("not large").select("g", "key", "nb", F.lit(0).cast("long").alias("q"), F.lit(1).cast("long").alias("far"))
    large = star.select("g", "key", "nb", F.floor(F.log(F.col("nb").cast("double")) / step).cast("long").alias("q"), F.when(F.col("linked"), 0).otherwise(1).cast("long").alias("far"))
    members = materialize(small.unionByName(large), "members")
    blocks = members.groupBy("g", "q", "far").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("nb") / BLOCK_NGRAMS)).cast("long").alias("blocks"))
    kinds = blocks.groupBy("g").agg(F.collect_list(F.struct("q", "far", "blocks")).alias("kinds"))  # a few dozen, whatever the group
    code = lambda q, far, b: (q * 2 + far) * F.lit(1 << 32) + b
    jobs = members.join(blocks, ["g", "q", "far"]).withColumn("own", code(F.col("q"), F.col("far"), F.pmod(F.xxhash64("key", "g"), F.col("blocks")))).join(kinds, "g")
    meets = F.filter("kinds", lambda k: (F.abs(k.q - F.col("q")) <= 1) & (k.far + F.col("far") > 0))
    jobs = jobs.select("g", "key", "own", F.explode(meets).alias("k")).select("g", "key", "own", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k.blocks") - 1)).alias("b"))
    other = code(F.col("k.q"), F.col("k.far"), F.col("b"))
    jobs = jobs.select("g", "key", "own", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"))
    dense = jobs.join(sets, "key").groupBy("g", "i", "j").applyInPandas(lambda pdf: _product(pdf, per_cent), "src long, dst long")
    return star.where("linked").select(F.col("key").alias("src"), F.col("pivot").alias("dst")).unionByName(dense)


def links(docs: DataFrame, n: int = N, per_cent: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents doc_id, n, s1, s2; classes of equal sets n, s1, s2, rows, rep; links src, dst between classes by s1). ``rep``
    is the smallest doc_id of a class. The links connect exactly what all pairs at or above the threshold connect."""
    spark = docs.sparkSession
    tune_arrow(spark)
    rows = docs.count()
    bits = min(24, max(12, math.ceil(math.log2(4 * rows + 1))))
    stats = materialize(measure(docs, bits, n), "measure")
    shared = spark.sparkContext.broadcast(counters(stats, bits))
    members = stats.where("chunk is null").select("doc_id", "n", "s1", "s2")
    reps = materialize(members.where("n > 0").groupBy("n", "s1", "s2").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep")), "classes")
    emitted = reps.agg(F.coalesce(F.sum(F.col("n") * (100 - per_cent) / 100 + 1), F.lit(0.0))).first()[0]
    parts = max(shuffle_partitions(spark), math.ceil(emitted / ROWS_IN_PART))
    dealt = incidence(docs, shared, bits, n, per_cent).repartition(parts, F.when(F.col("n") < 0, F.xxhash64("key")).otherwise(F.col("h")))
    product = materialize(multiply(dealt, per_cent), "product")

    pairs = product.where("c > 0").groupBy("a", "b").agg(F.max("na").cast("long").alias("na"), F.max("nb").cast("long").alias("nb"), F.sum("c").alias("c"))
    need = F.ceil((F.col("na") + F.col("nb")) * per_cent / (100 + per_cent) - 1e-9)
    after = F.greatest(F.ceil(F.col("na") * per_cent / 100.0 - 1e-9), F.ceil(F.col("nb") * per_cent / 100.0 - 1e-9)) - 1
    pairs = materialize(pairs.where(F.col("c") >= need - after).select("a", "b"), "pairs")
    groups = materialize(product.where("c = 0").select(F.col("a").alias("g"), F.col("b").alias("key"), "nb").distinct(), "groups")
    drop(product)
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(groups.select("key")).distinct()
    wanted = reps.select(F.col("s1").alias("key"), F.col("rep").alias("doc_id")).join(keys, "key")
    sets = materialize(full_sets(docs, wanted, n), "sets")

    left = pairs.join(sets.withColumnsRenamed({"key": "a", "grams": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"key": "b", "grams": "y"}), "b")
    checked = _checked(both, per_cent).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    dense = group_links(groups, sets, per_cent)
    found = materialize(checked.unionByName(dense).where("src <> dst"), "links")
    drop(pairs), drop(groups), drop(sets)
    return members, reps, found


def near_duplicates(docs: DataFrame, n: int = N, per_cent: int = THRESHOLD) -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs, named = identified(docs)
    members, reps, found = links(docs, n, per_cent)
    comps = materialize(connected_components(found).withColumnRenamed("node", "s1"), "components")
    names = reps.join(comps, "s1").groupBy("component").agg(F.min("rep").alias("name"))
    classes = reps.join(comps.join(names, "component"), "s1", "left").select("n", "s1", "s2", "rows", F.coalesce("name", "rep").alias("component_id"), F.col("name").isNotNull().alias("linked"))
    # classes of one row that are linked with nothing need no way back
    out = members.join(classes.where("rows > 1 or linked").drop("rows", "linked"), ["n", "s1", "s2"], "left")
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT a AS doc_id, a AS root FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id, n.n"""
