"""Models: gradients, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, pii, quality, samples, toxicity

from .conftest import NASTY, table


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_gru_gradients():
    """Backpropagation through time against central differences."""
    net = language_id.ByteGRU(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (7, 5)), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(x, y)
    for name, p in net.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in p.shape)
            if name[0] == "E":
                at = (int(rng.choice(x.ravel())), at[1])
            old = p[at]
            p[at] = old + 1e-4
            up = net.gradients(x, y)[0]
            p[at] = old - 1e-4
            down = net.gradients(x, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-5 + 1e-3 * abs(grads[name][at]), name


def test_gru_scores_whole_texts():
    """A text's sums are those of its windows, whatever stands beside it."""
    net = language_id.ByteGRU(["a", "b"], hidden=4)
    x = np.random.default_rng(5).integers(0, 257, (9, 6))
    assert np.allclose(net.position_log_probs(x).transpose(0, 2, 1), net.log_probs(x)[0], atol=1e-5)
    texts = [b"abc" * 100, b"", b"z", bytes(range(256)) * 3]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    together = net.score(data, off)
    for k, t in enumerate(texts):
        alone = net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)])) if t else np.zeros((1, 2))
        assert np.allclose(alone[0], together[k], atol=1e-3)


def test_language_id(spark, sf, nasty, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_id.fit(docs)
    got = language_id.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and held(r["doc_id"]) for r in got)
    out = language_id.identify(nasty, net).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(NASTY) and by[1] == by[2] == by[3] == by[12] == ("und", 0.0) and by[5][0] in net.classes
    kept = language_id.keep_identified(nasty, net)
    assert kept.columns == nasty.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in NASTY} - {1, 2, 3, 12}
    assert language_id.identify(empty, net).count() == 0 and language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(nasty, None).collect()} == {"und"}


def test_language_reads_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    net = language_id.ByteGRU(["en", "fr"])
    one = language_id.identify(docs, net).orderBy("doc_id").collect()
    two = language_id.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), net).orderBy("doc_id").collect()
    assert one == two


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    y = np.asarray(y)
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


def check_scores(spark, sf, nasty, empty, op, module, label, cut, least):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = op(spark, sf).join(labels.select("doc_id", label), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and held(r["doc_id"]) for r in out)
    assert auc(np.array([r["score"] for r in out]), [r[label] for r in out]) > least
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = module.fit(docs, labels)
    got = module.score(nasty, model).collect()
    assert len(got) == len(NASTY) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert by[1] == by[2]
    assert module.score(empty, model).count() == 0
    none = labels.limit(0)
    assert all(0 <= r["score"] <= 1 for r in module.score(nasty, module.fit(docs, none)).collect())
    assert all(0 <= r["score"] <= 1 for r in module.score(nasty, module.fit(docs, labels.where(f"{label} = 0"))).collect())


def test_toxicity(spark, sf, nasty, empty):
    check_scores(spark, sf, nasty, empty, toxicity.op2_toxicity, toxicity, "toxic", 0.3, 0.8)


def test_quality(spark, sf, nasty, empty):
    check_scores(spark, sf, nasty, empty, quality.op8_quality_classifier, quality, "quality", 0.7, 0.9)


def test_held_out_rows_are_never_learned(spark):
    rows = [(k, f"text {k}") for k in range(400)]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    got = samples.labelled_texts(docs, docs, "lang", 1000)
    assert {d for d, _, _ in got} == {k for k in range(400) if not held(k)}
    some = samples.labelled_texts(docs, docs, "lang", 20)
    assert 10 < len(some) < 80 and {x for *_, x in some} == {"a", "b"}
    assert samples.labelled_texts(docs, docs.limit(0), "lang", 5) == []


def test_every_class_is_sampled(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k % 500:03}") for k in range(5000)], "doc_id long, text string, lang string")
    got = samples.labelled_texts(docs, docs, "lang", 2)
    assert {r[2] for r in got} == {f"l{k % 500:03}" for k in range(5000) if not held(k)}
    assert len(got) <= 1500
    with pytest.raises(ValueError):
        samples.sample_ids(docs.withColumn("lang", F.col("doc_id")), "lang", 2)


def test_ngram_ratios_find_the_word():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    text = lambda bad: " ".join([word() for _ in range(60)] + (["ROTTEN"] if bad else []) + [word() for _ in range(60)])
    y = [k % 2 for k in range(200)]
    m = toxicity.NaiveBayesLinear.fit([text(v) for v in y], y)
    s = m.score([text(0), text(1), "rotten", "", None], m.table())
    assert s[0] < 0.3 < s[1] and s[2] > s[3] == s[4]
    long = m.score([text(0) * 50 + "rotten"], m.table())  # presence, not frequency
    assert 0 <= long[0] <= 1


def test_compression_prefers_its_own():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "quiet", "river", "runs", "under", "old", "stone", "bridges"], 80)) for _ in range(120)]
    bad = [" ".join(rng.choice(["$$$", "!!!", "###", "%%%", "click", "WIN"], 80)) for _ in range(120)]
    m = quality.train(good + bad, [1] * 120 + [0] * 120, 0.5, list(range(240)))
    both = m.compressors()
    p = lambda t: m.probability(np.array([m.difference(memoryview(t.encode()), both)]), np.array([len(t)]))[0]
    assert p(" ".join(["quiet river"] * 9)) > 0.5 > p("$$$ ### WIN !!! %%% click " * 9)


def test_semi_markov_gradient_and_best():
    """The gradient against differences, and Viterbi against the best of all segmentations."""
    text = "call 974 555 3436 or 10.0.0.1 now"
    r = pii.Region(text, 0, len(text))
    m = pii.SemiMarkov()
    ids = m._ids(r, True)
    rng = np.random.default_rng(3)
    m.w, m.pair = rng.normal(size=(len(m.names), 4)), rng.normal(size=(5, 4))
    gold = {0: ids[0][1][-1]}
    _, gw, gp = m.gradient(len(r.tok), r.candidates, ids, gold)
    for f, y in [(f, y) for f in list(gw)[:6] for y in range(4)]:
        old = m.w[f, y]
        m.w[f, y] = old + 1e-5
        up = m.gradient(len(r.tok), r.candidates, ids, gold)[0]
        m.w[f, y] = old - 1e-5
        down = m.gradient(len(r.tok), r.candidates, ids, gold)[0]
        m.w[f, y] = old
        assert abs((up - down) / 2e-5 - gw[f][y]) < 1e-4
    pot = m._potentials(ids)

    def best(at, last):
        out = (0.0, ())
        for k, c in enumerate(r.candidates):
            if c[0] >= at:
                for y in m.kinds_of(c):
                    s, rest = best(c[1] + 1, y)
                    s += pot[k, y] + m.pair[last, y]
                    if s > out[0]:
                        out = (s, ((pii.KINDS[y], *r.span(c)), *rest))
        return out

    assert tuple(m.segment(r)) == best(0, 4)[1]


def test_personal_data(spark, sf, nasty, empty):
    import re

    model = pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    out = pii.find_personal_data(nasty, model).collect()
    assert len(out) == len(NASTY) and all(r["spans"] == "" for r in out)
    assert pii.find_personal_data(empty, model).count() == 0
    said = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t, model)[1]]
    assert said("write to john dot doe at mail dot example dot com today") == [("email", "john dot doe at mail dot example dot com")]
    assert said("card 4111.1111.1111.1111 ok") == [("card", "4111.1111.1111.1111")]
    assert said("call (974) 555-3436 today") == [("phone", "(974) 555-3436")]
    assert said("version 3.10.11.999 and id 2390409500648960 on 2024-05-06") == []
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for t in ("a@b", "x.y@z.w@q.r", "@a.b c@d.e.", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.0.0.1", "+1 (974) 555-3436", "4111 1111-1111 1111 5", "99" * 5000, "a" * 100_000 + "@b.c", "é@a.b", ""):
        base = pii.base_spans(t)
        assert [x[1:] for x in base if x[0] == "email"] == [m.span() for m in email.finditer(t)]
        assert [x[1:] for x in base if x[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))] if len(t) < 5000 else True
        assert set(base) <= set(pii.find(t, model)[1])
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in rows[:300]:
        base = pii.base_spans(r["text"] or "")
        assert [x[1:] for x in base if x[0] == "email"] == [m.span() for m in email.finditer(r["text"] or "")]


def plain_personal(t):
    """The base spans straight from their patterns."""
    import re

    digits = lambda x: re.sub("[^0-9]", "", x)

    def checksum(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data_query_against_plain(spark, tmp_path):
    """Counts, digest and spans of whole texts, of all kinds and between them."""
    import hashlib

    rng = np.random.default_rng(11)
    bits = ["jo@mail.example.com", "a.b", "@", ".", "-", " ", "+1 (974) 555-3436", "+49 30 1234567", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "0", "12", "x", "é", "(", ")", "\n", "1.2.3.4.5", "% ", "word word "]
    rows = [(k, "".join(rng.choice(bits, rng.integers(0, 12)))) for k in range(600)] + [(700, None), (701, ""), (702, "word " * 20_000 + "jo@mail.example.com")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op9_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    seen = set()
    for d, t in rows:
        want = plain_personal(t or "")
        seen |= {k for k, _, _ in want}
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert got[d]["base_sha256"] == hashlib.sha256(pii.written(want).encode()).hexdigest()
        spans = got[d]["spans"].split(",") if got[d]["spans"] else []
        assert set(pii.written(want).split(",")) - {""} <= set(spans) and len(set(spans)) == len(spans)
    assert seen == set(pii.KINDS)


def test_personal_data_rewritten(spark, sf):
    """Held-out texts whose entities are written in other ways: precision and recall of the added spans."""
    import random

    docs = spark.read.parquet(f"{sf.replace('sf0.01', 'sf0.1')}/documents.parquet")
    model = pii.fit(docs)
    rng, wanted, added, both = random.Random(9), 0, 0, 0
    for r in docs.collect():
        if not held(r["doc_id"]) or not r["text"]:
            continue
        spans, out, gold, at = sorted(pii.base_spans(r["text"]), key=lambda x: x[1]), [], [], 0
        for kind, s, e in spans:
            if s < at or kind == "ip":
                continue
            out += [r["text"][at:s], pii._rewrites(rng, kind, r["text"][s:e]) or r["text"][s:e]]
            n = sum(map(len, out))
            gold.append((kind, n - len(out[-1]), n))
            at = e
        base, every = pii.find("".join(out) + r["text"][at:], model)
        gold, more = set(gold) - set(base), set(every) - set(base)
        wanted, added, both = wanted + len(gold), added + len(more), both + len(gold & more)
    assert wanted > 50 and both >= 0.9 * wanted and both >= 0.9 * added


def test_personal_data_sample(spark, monkeypatch):
    """Held-out rows stay out, texts are learned from whole, and long ones stay within the bounds."""
    got = []
    monkeypatch.setattr(pii, "train", got.extend)
    long = "first 1234 " + "word " * 9000 + " last@example.com"
    pii.fit(table(spark, [(k, f"{k} 5678 {long}") for k in range(40)]))
    assert sorted({int(t.split()[0]) for t in got}) == [k for k in range(40) if not held(k)]
    assert all(t.endswith(long) for t in got)
    got.clear()
    pii.fit(table(spark, [(k, f"{k} 5678 words") for k in range(4000)] + [(5000 + k, "no digits") for k in range(4000)]), sample=100)
    assert len(got) == 100
    monkeypatch.undo()
    seen = []
    monkeypatch.setattr(pii, "REGIONS", 30)
    monkeypatch.setattr(pii, "base_spans", lambda t: seen.append(t) or [])
    monkeypatch.setattr(pii.SemiMarkov, "train", lambda self, data: [])
    pii.train([("x " * 100).join(f"u{k}@example.com " for k in range(9)), ("x " * 100).join(f"v{k}@example.com " for k in range(3))], phrases=0)
    assert len(set(seen)) == 3 and any("v2@" in t for t in seen)


def test_personal_data_in_long_words(spark):
    """Regions are whole words, and unspaced texts take time in proportion."""
    text = "a" * 90 + ".b@mail." + "c" * 90 + ".example.com (974) 555-3436"
    assert pii.regions(text) == [(0, len(text))] and pii.regions("") == []
    m = pii.train([], phrases=50)
    assert pii.find("x." * 50_000 + "@b.c", m)[0] == [("email", 0, 100_004)]


def test_samples_are_whole_texts_within_bytes(spark):
    rows = [(k, f"{k} " + "word " * (20_000 if k == 3 else 200)) for k in range(120)]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "a").otherwise("b"))
    got = samples.labelled_texts(docs, docs, "lang", 1000, most_bytes=20_000)
    assert sum(len(t) for _, t, _ in got) <= 20_000 and {x for *_, x in got} == {"a", "b"} and 12 <= len(got) < 24
    assert all(t == dict(rows)[d] for d, t, _ in got)
    huge = samples.labelled_texts(docs.where("doc_id = 3"), docs, "lang", 1000, most_bytes=10)
    assert [d for d, _, _ in huge] == [3]


def test_toxicity_against_plain(spark, sf, tmp_path):
    """The query's scores by a loop over a text's n-grams."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.cell.tolist(), model.value.tolist(), strict=True))
    mask = 0xFFFFFFFF

    def cell(g, k, n):
        h = n * 0x61C88647 & mask
        for j, c in enumerate(g):
            h ^= ord(c) * int(toxicity._A[j]) & mask
            h = (h << 7 | h >> 25) & mask
        return ((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 32 - toxicity.BITS | k << toxicity.BITS

    for r in toxicity.op2_toxicity(spark, sf).join(docs.select("doc_id", "text"), "doc_id").where("length(text) < 1500 or text is null").orderBy("doc_id").limit(60).collect():
        t = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "") + " "
        cells = {cell(t[i : i + n], k, n) for k, n in enumerate(toxicity.ORDERS) for i in range(len(t) - n + 1)}
        s = sum(weight.get(c, 0.0) for c in cells) + model.bias
        assert abs(r["score"] - 1 / (1 + np.exp(-s))) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_against_plain(spark, sf):
    """The query's scores by compressing every block anew."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    m = quality.fit(docs, labels)

    def size(raw, dictionary):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK))

    for r in quality.op8_quality_classifier(spark, sf).join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").limit(40).collect():
        raw = (r["text"] or "").encode()
        x = (size(raw, m.bad) - size(raw, m.good)) / len(raw) if raw else 0.0
        told = len(raw) / (len(raw) + quality.LITTLE)
        assert abs(r["score"] - 1 / (1 + np.exp(-(told * (m.slope * x + m.bias) + (1 - told) * m.prior)))) < 1e-6


def test_rows_stay_without_a_network(spark, nasty):
    kept = language_id.keep_identified(nasty, None)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in NASTY} - {1, 2, 3, 12}
