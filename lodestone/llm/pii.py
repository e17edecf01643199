"""Personal data by a semi-Markov conditional random field.

The base patterns find plain e-mail addresses, IP addresses, card and phone numbers. Around every digit run, @ and
written-out "at" or "dot" the text is cut into tokens, and every span of at most ``MAX_TOKENS`` tokens that could be an
entity is a candidate segment. A log-linear model scores candidates by features of the whole span (digit count and
grouping, checksum, separators, domain shape, what stands left and right), plus one for the kind of the entity before;
dynamic programming over the tokens picks the segmentation, boundaries and kinds together. It is trained by
conditional likelihood (forward-backward over the candidates, Adam) on a bounded sample of texts whose base spans are the
gold segments, and on rewritten copies of them in which addresses are spelled out and numbers regrouped. Predicted spans
that overlap no base span are added to the base ones.

Sample: ``SAMPLE`` texts at most that contain a run of four digits or an @ and aren't held out, whole,
``samples.MOST_BYTES`` together; they are learned from one after the other until they had ``REGIONS`` stretches, and a text
that has more than a tenth of that is left out (the bounds). Edge cases: null and empty texts have no spans; repeated rows are
scanned alike, a null doc_id like any other; of equal segmentations the one with fewer entities is taken; empty tables give no
rows; other columns are ignored; without a sample the built-in training phrases alone train the model.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import drop, materialize

from .common import held_out, slices, table, tune_arrow
from .samples import MOST_BYTES, within

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, SAMPLE, MARGIN, REGIONS = 26, 1500, 48, 3000
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        left = at
        while left > floor and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns: leftmost, non-overlapping per kind, failing matches dropped; by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-400:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _DIGITS.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_TRIGGER = re.compile(r"@|[0-9][0-9 .()-]{5,}[0-9]|[\[({<] ?(?:at|AT|dot|DOT) ?[\])}>]|(?<=\w) (?:at|AT) (?=[\w.-]+ (?:dot|DOT) )")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_MARKS = {"at": 1, "AT": 1, "dot": 2, "DOT": 2}


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words around what could belong to an entity; neighbours are joined."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        floor = out[-1][1] if out else 0
        s, e = max(floor, m.start() - MARGIN), max(floor, min(len(text), m.end() + MARGIN))
        while s > floor and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if out and s == floor:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


class Region:
    """Tokens of a stretch and its candidate segments (first token, last token, numeric or address)."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        got = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, end)]
        self.start, self.end, self.tok = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
        self.candidates: list[tuple[int, int, str]] = []
        self._propose()

    def _propose(self) -> None:
        n = len(self.tok)
        tok, start, end = self.tok, self.start, self.end
        digits = [len(t) if t[0] in "0123456789" else 0 for t in tok]
        numeric = [d > 0 or t in "+-.()" for d, t in zip(digits, tok, strict=True)]
        mark = [_MARKS.get(t, 0) for t in tok]
        word = [t.isascii() and (t.isalnum()) for t in tok]
        gap = [0, *(start[k] - end[k - 1] for k in range(1, n))]
        sign = [n] * (n + 1)  # the next @ or "at"
        for k in range(n - 1, -1, -1):
            sign[k] = k if tok[k] == "@" or mark[k] == 1 else sign[k + 1]
        for i in range(n):
            if digits[i] or tok[i] in "+(":  # numbers: digits and separators, gaps of one space
                total, j = 0, i
                while j < n and j - i < MAX_TOKENS and numeric[j] and (j == i or (gap[j] <= 1 and not (gap[j] and self.text[end[j - 1]] != " "))) and total <= 19:
                    total += digits[j]
                    if digits[j] and 7 <= total <= 19 and (j + 1 == n or gap[j + 1] or not (digits[j + 1] and gap[j + 1] == 0)):
                        self.candidates.append((i, j, "number"))
                    elif digits[j] and j - i >= 6 and 4 <= total < 7 and tok[i + 1] == ".":
                        self.candidates.append((i, j, "number"))
                    j += 1
            if sign[i] - i < MAX_TOKENS and word[i] and not mark[i] and (i == 0 or gap[i] or tok[i - 1] not in "._%+-"):
                ats = dots = 0
                j = i
                while j < n and j - i < MAX_TOKENS:
                    if j > i and gap[j]:
                        # a space is allowed only beside a spelled-out mark or its bracket
                        near = mark[j] or mark[j - 1] or tok[j] in "[({<" or tok[j - 1] in "])}>"
                        if gap[j] > 1 or not near or self.text[end[j - 1]] == "\n":
                            break
                    if tok[j] == "@" or mark[j] == 1:
                        ats += 1
                    elif ats and (tok[j] == "." or mark[j] == 2):
                        dots += 1
                    elif not word[j] and tok[j] not in "._%+-[](){}<>":
                        break
                    if ats > 1:
                        break
                    if ats == 1 and dots and word[j] and not mark[j] and (j + 1 == n or gap[j + 1] or tok[j + 1] != "-"):
                        self.candidates.append((i, j, "address"))
                    j += 1

    def span(self, c) -> tuple[int, int]:
        return self.start[c[0]], self.end[c[1]]


def _side(c: str) -> str:
    return "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-.@(_/=\"'" else "mark"


def features(r: Region, c) -> list[str]:
    """Of the whole span; the kinds are multiplied in by the model."""
    i, j, shape = c
    s, e = r.span(c)
    text = r.text[s:e]
    before, after = r.text[s - 1 : s] if s else "", r.text[e : e + 1]
    f = [shape, shape + " left " + _side(before), shape + " right " + _side(after), shape + " right2 " + _side(after) + _side(r.text[e + 1 : e + 2])]
    if i:
        f.append("word " + r.tok[i - 1].lower()[:8])
    if shape == "number":
        groups = [len(t) for t in r.tok[i : j + 1] if t[0].isdigit()]
        digits = "".join(t for t in r.tok[i : j + 1] if t[0].isdigit())
        marks = "".join(sorted({t for t in r.tok[i : j + 1] if not t[0].isdigit()} | ({"_"} if " " in text else set())))
        good = luhn(digits) and 13 <= len(digits) <= 19
        quad = len(groups) == 4 and text.count(".") == 3 and marks == "." and all(int(x) <= 255 for x in text.split("."))
        plus = text[0] == "+"
        f += [f"n {len(digits)}", f"groups {'-'.join(map(str, groups[:6]))}", f"marks {marks}", f"luhn {good} {len(digits)}", f"luhn {good} {len(groups) == 1}", f"quad {quad}", f"plus {plus} {9 <= len(digits) <= 15}", f"plus {plus} {marks}", f"count {min(len(groups), 6)} {marks}"]
    else:
        local = text.split("@")[0] if "@" in text else re.split(r"[\[({<]? ?(?:at|AT) ?[\])}>]?", text)[0]
        last = r.tok[j]
        f += [f"sign {'@' in text}", f"spelled {sum(t in _MARKS for t in r.tok[i : j + 1])}", f"bracket {any(b in text for b in '[({<')}", f"top {min(len(last), 7)} {last.isalpha()} {last.islower()}", f"local {min(len(local), 12)}", f"space {' ' in text} {'@' in text}", f"longer {_side(after)} {_side(r.text[e + 1 : e + 2])}"]
    return f


class SemiMarkov:
    """Weights of (kind, feature) and of (kind before, kind)."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.pair = np.zeros((len(KINDS) + 1, len(KINDS)))

    @staticmethod
    def kinds_of(c) -> tuple[int, ...]:
        return (0,) if c[2] == "address" else (1, 2, 3)

    def _potentials(self, ids) -> np.ndarray:
        out = np.full((len(ids), len(KINDS)), -np.inf)
        for k, (row, kinds) in enumerate(ids):
            s = self.w[row].sum(axis=0)
            for y in kinds:
                out[k, y] = s[y]
        return out

    def _ids(self, r: Region, grow: bool):
        out = []
        for c in r.candidates:
            row = []
            for name in features(r, c):
                k = self.names.get(name)
                if k is None and grow:
                    k = self.names[name] = len(self.names)
                if k is not None:
                    row.append(k)
            out.append((row, self.kinds_of(c)))
        return out

    def _forward(self, n: int, cand, pot):
        """alpha[p][s]: log-sum over segmentations of the first p tokens whose last entity is s (last row: none yet)."""
        none = len(KINDS)
        a = np.full((n + 1, none + 1), -np.inf)
        a[0, none] = 0
        by_end: dict[int, list[int]] = {}
        for k, c in enumerate(cand):
            by_end.setdefault(c[1] + 1, []).append(k)
        for p in range(1, n + 1):
            a[p] = a[p - 1]
            for k in by_end.get(p, ()):
                prev = a[cand[k][0]]
                for y in self.kinds_of(cand[k]):
                    v = np.logaddexp.reduce(prev + self.pair[:, y]) + pot[k, y]
                    a[p, y] = np.logaddexp(a[p, y], v)
        return a, by_end

    def gradient(self, n: int, cand, ids, gold):
        """Log-likelihood and its gradient by forward-backward; gold: {candidate: kind}."""
        pot = self._potentials(ids)
        a, _ = self._forward(n, cand, pot)
        none = len(KINDS)
        z = np.logaddexp.reduce(a[n])
        b = np.full((n + 1, none + 1), -np.inf)
        b[n] = 0
        by_start: dict[int, list[int]] = {}
        for k, c in enumerate(cand):
            by_start.setdefault(c[0], []).append(k)
        gw: dict[int, np.ndarray] = {}
        gp = np.zeros_like(self.pair)
        for p in range(n - 1, -1, -1):
            b[p] = b[p + 1]
            for k in by_start.get(p, ()):
                q = cand[k][1] + 1
                for y in self.kinds_of(cand[k]):
                    way = self.pair[:, y] + pot[k, y] + b[q, y]
                    b[p] = np.logaddexp(b[p], way)
                    mass = np.exp(a[p] + way - z)
                    gp[:, y] -= mass
                    total = mass.sum()
                    if total > 1e-9:
                        for f in ids[k][0]:
                            gw.setdefault(f, np.zeros(none))[y] -= total
        score, last = 0.0, none
        for k in sorted(gold, key=lambda k: cand[k][0]):
            y = gold[k]
            score += pot[k, y] + self.pair[last, y]
            gp[last, y] += 1
            for f in ids[k][0]:
                gw.setdefault(f, np.zeros(none))[y] += 1
            last = y
        return score - z, gw, gp

    def train(self, regions_: list[tuple[Region, list[tuple[str, int, int]]]], rounds: int = 8, rate: float = 0.05, decay: float = 1e-3, seed: int = 3) -> list[float]:
        data = []
        for r, spans in regions_:
            where = {(*r.span(c), c[2] == "address"): k for k, c in enumerate(r.candidates)}
            gold = {where[s, e, kind == "email"]: KINDS.index(kind) for kind, s, e in spans if (s, e, kind == "email") in where}
            if r.candidates:
                data.append((len(r.tok), r.candidates, self._ids(r, True), gold))
        self.w = np.zeros((len(self.names), len(KINDS)))
        m, v, mp, vp = np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.pair), np.zeros_like(self.pair)
        rng, step, history = random.Random(seed), 0, []
        for _ in range(rounds):
            rng.shuffle(data)
            total = 0.0
            for k in range(0, len(data), 16):
                gw, gp = np.zeros_like(self.w), np.zeros_like(self.pair)
                for n, cand, ids, gold in data[k : k + 16]:
                    ll, dw, dp = self.gradient(n, cand, ids, gold)
                    total += ll
                    gp += dp
                    for f, x in dw.items():
                        gw[f] += x
                step += 1
                for p, g, m1, v1 in ((self.w, gw - decay * self.w, m, v), (self.pair, gp - decay * self.pair, mp, vp)):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.01 * (g * g - v1)
                    p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-6)
            history.append(-total / max(1, len(data)))
        return history

    def segment(self, r: Region) -> list[tuple[str, int, int]]:
        """The best segmentation: Viterbi over the tokens."""
        cand = r.candidates
        if not cand:
            return []
        pot = self._potentials(self._ids(r, False))
        n, none = len(r.tok), len(KINDS)
        best = np.full((n + 1, none + 1), -np.inf)
        best[0, none] = 0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        by_end: dict[int, list[int]] = {}
        for k, c in enumerate(cand):
            by_end.setdefault(c[1] + 1, []).append(k)
        for p in range(1, n + 1):
            best[p] = best[p - 1]
            for k in by_end.get(p, ()):
                i = cand[k][0]
                for y in self.kinds_of(cand[k]):
                    way = best[i] + self.pair[:, y]
                    s = int(way.argmax())
                    value = way[s] + pot[k, y]
                    if value > best[p, y]:
                        best[p, y] = value
                        back[p, y] = (k, i, s)
        out, p, s = [], n, int(best[n].argmax())
        while s != none:
            while (p, s) not in back or best[p, s] == best[p - 1, s]:
                p -= 1
            k, i, before = back[p, s]
            out.append((KINDS[s], *r.span(cand[k])))
            p, s = i, before
        return out[::-1]


def _rewrites(rng: random.Random, kind: str, value: str) -> str | None:
    """Another way to write an entity, of the same kind; None leaves it."""
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" AT ", " DOT "), (" (at) ", "."), ("[at]", "."), (" @ ", ".")])
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot) if at != " @ " else None
    d = _DIGITS.sub("", value)
    if kind == "card":
        sep = rng.choice([" ", "-", "."])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    if kind == "phone":
        d = d[-10:]
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "({}){}-{}", "1-{}-{}-{}"]).format(d[:3], d[3:6], d[6:])
    return None


def _phrases(rng: random.Random, n: int) -> list[str]:
    """Plain training phrases: every kind, and numbers that are none."""
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = rng.choice("3456") + digits(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def bad():
        d = digits(16)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    makers = [lambda: f"{word()}.{digits(2)}@{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{rng.randint(20, 99)} {digits(3)} {digits(7)}",
              bad, lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{digits(2)}.{digits(3)}.{digits(3)}.{rng.randint(300, 999)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{digits(4)}", lambda: digits(rng.randint(7, 12)), lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{word()} at {word()} dot", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(8)}-{digits(4)}-{digits(4)}-{digits(4)}-{digits(12)}"]
    return [" ".join(x for k in range(rng.randint(1, 3)) for x in (word(), word(), rng.choice(makers)(), rng.choice([word(), word() + "."]))) for _ in range(n)]


def train(texts: list[str], seed: int = 5, phrases: int = 800) -> SemiMarkov:
    rng = random.Random(seed)
    pieces = _phrases(rng, phrases)
    most = len(pieces) + REGIONS
    for t in texts:
        found = regions(t)
        if len(pieces) < most and len(found) <= max(1, REGIONS // 10):
            pieces += [t[s:e] for s, e in found]
    data = []
    for piece in pieces:
        spans = sorted(base_spans(piece), key=lambda x: x[1])
        spans = [x for k, x in enumerate(spans) if k == 0 or x[1] >= spans[k - 1][2]]
        for rewrite in (False, True):
            if rewrite and not spans:
                continue
            out, gold, at = [], [], 0
            for kind, s, e in spans:
                new = (_rewrites(rng, kind, piece[s:e]) if rewrite else None) or piece[s:e]
                out.append(piece[at:s])
                begin = sum(map(len, out))
                out.append(new)
                gold.append((kind, begin, begin + len(new)))
                at = e
            text = "".join(out) + piece[at:]
            for s, e in regions(text):
                data.append((Region(text, s, e), [g for g in gold if g[1] >= s and g[2] <= e]))
    rng.shuffle(data)
    model = SemiMarkov()
    model.history = model.train(data)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    """Trains on ``sample`` texts with a digit run or an @, those of lowest hash; never a held-out row.

    The share of rows to look at comes from their number, so the patterns run over few texts; where those have too few
    finds, more are looked at."""
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    hashed = F.xxhash64("doc_id", F.lit("pii"))
    share = min(1.0, 2 * sample / max(1, rows.count()))
    while True:
        some = materialize(rows.where((F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("text").rlike("@|[0-9]{4}")), "sample")
        if share == 1 or some.count() >= sample:
            break
        drop(some)
        share = min(1.0, 8 * share)
    few = some.orderBy(hashed, "doc_id", "text").limit(sample).withColumn("label", F.lit(0))
    got = within(few, "label", MOST_BYTES).select("text").orderBy(F.xxhash64("text"), "text").collect()
    drop(some)
    return train([r[0] for r in got])


def find(text: str, model: SemiMarkov) -> tuple[list, list]:
    """(base spans, all spans), by kind, then start."""
    base = base_spans(text)
    taken: list[list[int]] = []  # the base spans united, by place
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    more, k = [], 0
    for s, e in regions(text):
        for kind, a, b in model.segment(Region(text, s, e)):  # in order, so one pass over both
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or b <= taken[k][0]:
                more.append((kind, a, b))
    return base, sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    tune_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for rows in slices(batches):
            out = [find(t or "", shared.value) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array([sum(s[0] == k for s in b) for b, _ in out], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in out]), pa.array([written(a) for _, a in out])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))
