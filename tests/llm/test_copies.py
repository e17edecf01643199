"""Exact dedup, the n-gram join, decontamination and packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from .conftest import NASTY, table
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, ngram_join, packing

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


def fold(t):
    return (t or "").translate(FOLD)


def corpus(seed, n=120, words=40):
    """Random texts with exact copies, near copies of one hub, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    hub, passage, rows = say(120), say(30), []
    for k in range(n):
        kind = k % 6
        if kind == 0:
            t = say(rng.randint(0, words))
        elif kind == 1:
            t = list(hub)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind == 2:
            t = say(6) + passage + say(rng.randint(1, 8))
        elif kind == 3 and rows:
            t = rng.choice(rows)[1].split(" ")
            t = [w.upper() if rng.random() < 0.3 else w for w in t]
        elif kind == 4 and rows:
            t = rng.choice(rows)[1].split(" ") + say(1)
        else:
            t = say(rng.randint(0, 6))
        rows.append((k + 1, " ".join(t)))
    return rows


def plain_near(rows):
    sets, first = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("seed, blocks", [(1, 1024), (2, 7)])
def test_ngram_join_against_plain(spark, monkeypatch, tmp_path, seed, blocks):
    """As the query and with its smallest blocks and combinations."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    monkeypatch.setattr(ngram_join, "FAN_IN", 2 if blocks == 7 else 256)
    rows = corpus(seed, 240)
    table(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = ngram_join.op5_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_near(rows)
    assert max(len([1 for v in plain_near(rows).values() if v[1] == c]) for c in {v[1] for v in plain_near(rows).values()}) > ngram_join.LONG_COLUMN


@pytest.mark.parametrize("seed, per_cent", [(1, 80), (2, 50), (3, 100)])
def test_group_links_against_all_pairs(spark, monkeypatch, seed, per_cent):
    """Components of large and small groups of sets around several hubs, of sizes that differ widely."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    rng, sets, groups = random.Random(seed), {}, []
    for g in range(4):
        hubs = [sorted(rng.sample(range(1000 * g, 1000 * g + 400), n)) for n in (10, 12, 60, 70, 200)]
        for _ in range((3, 60, 60, 90)[g]):
            s = set(rng.choice(hubs))
            for x in rng.sample(sorted(s), rng.randint(0, len(s) // 5)):
                s.remove(x)
            s |= {rng.randrange(10_000) for _ in range(rng.randint(0, 3))}
            sets[len(sets)] = sorted(s)
            groups.append((g, len(sets) - 1, len(s)))
    found = ngram_join.group_links(spark.createDataFrame(groups, "g long, key long, nb int"), spark.createDataFrame(list(sets.items()), "key long, grams array<long>"), per_cent).collect()

    def parts(pairs):
        root = {k: k for k in sets}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {k: top(k) for k in sets}

    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) * 100 >= len(set(sets[a]) | set(sets[b])) * per_cent
    own = {k: g for g, k, _ in groups}
    want = [(a, b) for a in sets for b in sets if a < b and own[a] == own[b] and alike(a, b)]
    assert all(alike(r["src"], r["dst"]) or parts(want)[r["src"]] == parts(want)[r["dst"]] for r in found)
    assert parts((r["src"], r["dst"]) for r in found) == parts(want) and len(set(parts(want).values())) > 4


def test_ngram_join_with_odd_ids(spark):
    """Null ids are linked too, and an id with several texts is several documents."""
    w = [f"w{j}" for j in range(60)]
    x = [f"x{j}" for j in range(60)]
    rows = [(4, " ".join(w)), (None, " ".join(w[:-1] + ["z"])), (None, " ".join(x)), (None, " ".join(x[:-1] + ["z"])), (7, "one text of id seven here"), (7, " ".join(w[:-1])), (7, " ".join(["v", *x[1:]])), (None, "alone among all the others here"), (None, None), (9, "One text of id seven here")]
    got = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(4, 56, 4), (None, 56, 4), (None, 56, 7), (None, 56, 7), (7, 2, 7), (7, 55, 4), (7, 56, 7), (None, 2, None), (None, 0, None), (9, 2, 7)], key=str)


def test_ngram_join_hot_columns_are_groups(spark):
    """Rows marked hot (n < 0) become members of their column's group; short columns give counted pairs, long ones groups."""
    rows = [(5, k, -9) for k in range(3)] + [(6, k, 9) for k in range(2)] + [(7, k, 9) for k in range(2)] + [(8, k, 9) for k in range(20)] + [(9, 1, 10), (9, 2, 100)]
    got = ngram_join.multiply(spark.createDataFrame(rows, "h long, key long, n int").coalesce(1), 80).collect()
    assert sorted((r["a"], r["b"]) for r in got if r["c"] == 0) == sorted([(5, 0), (5, 1), (5, 2)] + [(0, k) for k in range(20)])
    assert [(r["a"], r["b"], r["c"]) for r in got if r["c"]] == [(0, 1, 2)]


def test_ngram_join_edges(spark, nasty, empty):
    got = ngram_join.near_duplicates(nasty).collect()
    assert len(got) == len(NASTY)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 5) and by[6] == (1, 5) and by[11] == (1, 5)
    assert by[7][0] == 1 and by[8] == (1, 8) and by[9][1] == 9
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_threshold_is_exact(spark):
    """Nine of eleven n-grams shared is 81.8 %; eight of ten in common with twelve in all is below."""
    base = [f"a{k}" for k in range(14)]  # ten n-grams
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base[:12])), (4, " ".join(["y", "y2"] + base[2:]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in plain_near(rows).items()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 20_000):
        keys = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        f = exact_dedup.FuseFilter.build(np.concatenate([keys, keys[:2]]))
        assert f.contains(keys).all()
        other = rng.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64)
        assert f.contains(other).mean() < 0.02 or n == 0


def plain_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    return sorted((d, max(groups[fold(t)]), len(groups[fold(t)]), d == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for d, t in rows)


@pytest.mark.parametrize("condition", ["doc_id % 2 = 0", "true", "false"])
def test_exact_dedup_against_plain(spark, condition):
    rows = corpus(3)
    got = exact_dedup.exact_dedup(table(spark, rows), F.expr(condition)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_exact(rows)


def test_exact_dedup_edges(spark, nasty, empty):
    got = exact_dedup.exact_dedup(nasty, exact_dedup.snapshot_half(F.col("doc_id"))).collect()
    assert len(got) == len(NASTY)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == 2 and by[1]["group_size"] == 2 and by[5]["keep_id"] == 11 and by[11]["kept"] and by[9]["kept"] and by[9]["group_size"] == 2
    assert by[None]["kept"]
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def plain_rows(rows):
    """By rows: null ids are below all others, and rows of equal id and text are one document."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    low = lambda d: (d is not None, d or 0)
    return sorted(((d, max(groups[fold(t)], key=low), len(groups[fold(t)]), d == max(groups[fold(t)], key=low), hashlib.sha256(fold(t).encode()).hexdigest()) for d, t in rows), key=str)


ODD_IDS = [(0, "a"), (0, "b"), (2, "a"), (None, "a"), (None, "c"), (None, "C"), (None, "d"), (3, "D"), (4, "e"), (4, "E"), (4, "e"), (1 << 60, "f"), ((1 << 60) + 1, "F"), (5, None), (6, "")]


@pytest.mark.parametrize("condition", ["doc_id % 2 = 0", "text = lower(text)", "coalesce(doc_id, 0) < 3", "false"])
def test_exact_dedup_with_odd_ids(spark, monkeypatch, condition):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 1)
    got = exact_dedup.exact_dedup(table(spark, ODD_IDS), F.expr(f"coalesce({condition}, false)")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got), key=str) == plain_rows(ODD_IDS)


def test_dedup_against_stored_snapshots(spark, tmp_path):
    """A batch against two snapshots that were written before and are read again."""
    rows = corpus(8, 180)
    parts = [[r for r in rows if r[0] % 3 == k] for k in range(3)]
    for k in (1, 2):
        exact_dedup.Snapshot.write(table(spark, parts[k]), str(tmp_path / f"s{k}"))
    snapshots = [exact_dedup.Snapshot.read(table(spark, parts[k]), str(tmp_path / f"s{k}")) for k in (1, 2)]
    got = exact_dedup.dedup_batch(table(spark, parts[0]), snapshots).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == [r for r in plain_exact(rows) if r[0] % 3 == 0]
    alone = exact_dedup.dedup_batch(table(spark, parts[0]), []).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in alone) == plain_exact(parts[0])


def test_exact_dedup_query(spark, tmp_path):
    rows = corpus(9)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.op10_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_exact(rows)


def test_equal_digest_needs_equal_bytes(spark):
    """A pair whose texts differ is not joined, whatever its digest says."""
    docs = table(spark, [(1, "Same"), (2, "sAME"), (2, "more"), (3, "other"), (4, "same")], False)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pairs = spark.createDataFrame([(sha("same"), 1, 2), (sha("other"), 1, 3)], "sha string, old_id long, keep_id long")
    assert [r[0] for r in exact_dedup.same_bytes(docs, pairs).collect()] == [sha("same")]


def plain_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(fold(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = word.findall(fold(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def bench_rows(seed, rows):
    rng = random.Random(seed)
    out = [(1, "short one"), (2, None), (3, "?!"), (4, ""), (5, "w1"), (5, "again w2 w3"), (6, "é" * 3)]
    for k in range(12):
        t = rng.choice(rows)[1].split(" ")
        s = rng.randrange(max(1, len(t) - 12))
        out.append((10 + k, ", ".join(t[s : s + 14]).upper()))
    return out


@pytest.mark.parametrize("block", [32_000_000, 60])
def test_decontamination_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = corpus(4) + [(900, "nothing"), (901, "éé ééé short one"), (902, "short - one short ONE")]
    items = bench_rows(5, rows)
    got = decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_contamination(rows, items)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in got) == sorted(want)
    texts = dict(rows)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        passages = [raw[h["start"] : h["end"]].decode() for h in r["hits"]]
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(p))) for p in passages) == r["n_hit"]
        assert (r["longest"] > 0) == (r["n_hit"] > 0)


def test_longest_match_and_cleaning(spark):
    text = " ".join(f"k{j}" for j in range(40))
    docs = table(spark, [(1, "x y " + " ".join(f"k{j}" for j in range(3, 28)) + " z"), (2, "clean text"), (3, None)])
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).where("doc_id = 1").first()
    assert (r["longest"], r["longest_item"], r["n_hit"]) == (25, 7, 25)
    kept = decontaminate.clean(docs, bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_decontamination_edges(spark, nasty, empty):
    bench = spark.createDataFrame([(1, "lorem " * 12), (2, None)], "item_id long, text string")
    by = {r["doc_id"]: r for r in decontaminate.contamination(nasty, bench).collect()}
    assert by[8]["n_hit"] == 30_000 and by[1]["n_words"] == 0 and by[10]["n_hit"] == 0 and len(by) == len({d for d, _ in NASTY})
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(nasty, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [32_000_000, 60])
def test_decontamination_with_null_ids(spark, monkeypatch, block):
    """Null items and null documents count, in one block or several."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    one, two = (" ".join(f"{c}{j}" for j in range(12)) for c in "kq")
    docs = table(spark, [(None, one), (None, "clean text"), (1, one + " x " + two), (1, "clean twin"), (2, two)])
    bench = spark.createDataFrame([(None, one), (7, two)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["longest_item"]) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, 12, 12, [None], None), (None, 2, 0, [], None), (1, 25, 24, [7, None], got[[g[1] for g in got].index(25)][4]), (1, 2, 0, [], None), (2, 12, 12, [7], 7)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["clean text", "clean twin"]


def check_packing(rows, got, path, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    seq = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for p in seq.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for d, texts in want.items():
        left = sorted(pieces[d])
        for ids in sorted(texts, key=len):
            at = 0
            while at < len(ids) // 4:
                k = next(k for k, p in enumerate(left) if p[0] == at and p[3] == len(ids) // 4)
                start, length, crc, _ = left.pop(k)
                assert zlib.crc32(ids[4 * start : 4 * (start + length)]) == crc
                at += length
        assert not left
    return sum(capacity - sum(x[1] for x in p) for p in seq.values()), len(seq)


def test_packing_round_trip(spark, nasty, empty):
    path = packing.tokenizer_path()
    rows = NASTY + [(20, "<|endoftext|> and <|startoftext|>"), (21, "a\x1cb\x85c"), (22, "ΣΑΣ'S i'll  x y　z"), (23, "é ́a")]
    got = packing.pack_documents(table(spark, rows), path).collect()
    check_packing(rows, got, path)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_leaves_little(spark):
    rows = corpus(6, 600, 400)
    docs = table(spark, rows).repartition(2)
    got = packing.pack_documents(docs, packing.tokenizer_path(), capacity=256).collect()
    padding, windows = check_packing(rows, got, packing.tokenizer_path(), 256)
    assert padding / (256 * windows) < 0.02


def test_window_count_rises():
    """Where the near-equal windows exceed the capacity there are more of them; nothing is lost."""
    pieces = [(k, 0, 60) for k in range(5)]
    w = packing.pack(pieces, capacity=100, divisible=0)
    assert len(w) == 5 and sorted(p for g in w for p in g) == pieces
    assert len(packing.pack(pieces, capacity=100, divisible=0.5)) == 3
    rng = random.Random(7)
    rose = 0
    for _ in range(60):  # full bundles, as they come
        pieces, room = [], 64 * 2048
        while room:
            n = min(room, int(rng.lognormvariate(6.3, 0.7)) + 1)
            pieces.append((len(pieces), 0, n))
            room -= n
        w = packing.pack(pieces)
        rose += len(w) > 64
        assert len(w) <= 66 and all(sum(p[2] for p in g) <= 2048 for g in w)
        assert len(packing.pack(pieces, divisible=0)) > 64
    assert rose


def test_packing_covers_everything():
    rng = random.Random(1)
    for _ in range(40):
        pieces = [(k, 0, rng.randint(1, 300)) for k in range(rng.randint(1, 40))]
        w = packing.pack(pieces, 128, rng.choice([0, 0.04, 0.3, 1]))
        assert all(sum(p[2] for p in g) <= 128 for g in w)
        cover = defaultdict(int)
        for d, s, n in (p for g in w for p in g):
            for x in range(s, s + n):
                cover[d, x] += 1
        assert all(v == 1 for v in cover.values()) and len(cover) == sum(p[2] for p in pieces)


def test_words_have_the_whole_tokenizers_ids():
    """Text by text and word by word give the same ids, over odd letters, marks, spaces and full caches."""
    tok = packing.WordTokens(packing.tokenizer_path())
    rng = random.Random(3)
    bits = ["'s", "'S", "don't", "İ", "ı", "ſ", "ΣΑΣ", "É", "ß", "ẞ", "é", "ñ", "²", "½", "ª", "µ", "ŉ", "K", "­", "​", "日本", "\U0001f642", "...", "!?", "1", "23", "_", "-", "''s", '"', "«", "A", "z", "Ǆ", "ĳ", "ﬁ", "word,", "Word.", " ", " ", "\t", " ", "　", "\x1c", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + [None, ""]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        if k == 3000:
            tok.words.runs.clear()
            tok.words = packing._Words(tok.tok, tok.words.runs, dict(tok.words))
        for t, got in zip(part, tok.many(part), strict=True):
            assert got == np.array(tok.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t
