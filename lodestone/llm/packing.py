"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Every task packs its own rows: documents are tokenised, whole windows inside a document are windows at once, and what is
left of the documents is gathered in bundles of ``WINDOWS`` windows of tokens (the document at the border is cut
there). A bundle is divided into m windows by differencing: the two partial
partitions of largest spread are merged with opposing imbalances until one is left. Whenever one of the near-equal
windows exceeds the capacity, the window count rises and the bundle is divided anew. The longest pieces, about
``DIVISIBLE`` of the tokens, take no part: they are cut at the end to level the windows out. Where one window more isn't
enough (pieces just above half a window, say), twice as much is cut. So a bundle has a window of padding at most; with 0
nothing is cut for that, the count rises as far as it must, and some 3 % of common texts' windows is padding. Nothing is shuffled and a task's memory is that of one
bundle.

Edge cases: null text is the empty text and has the one id 1; special-token strings and odd white space in a text go
through the tokenizer as a whole; repeated rows are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tune_arrow

CAPACITY = 2048
WINDOWS = 64
DIVISIBLE = 0.04
CACHED_WORDS = 400_000
END_ID = 1
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85"
_LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+").fullmatch
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall  # fixed: the tokenizer file's own pattern


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indexes of ``sizes`` in m groups of near-equal sums."""
    n = len(sizes)
    if m == 1 or n == 0:
        return [list(range(n))] + [[] for _ in range(m - 1)]
    left, right = [-1] * n, [-1] * n
    heap = []
    for i, size in enumerate(sizes):
        sums, ids = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[0], ids[0] = size, i
        heap.append((-int(size), i, sums, ids))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        b, ib = b[::-1], ib[::-1]
        sums, ids = a + b, np.where(ia >= 0, ia, ib)
        for k in np.flatnonzero((ia >= 0) & (ib >= 0)).tolist():
            left.append(int(ia[k]))
            right.append(int(ib[k]))
            ids[k] = len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order] - sums[order[-1]], ids[order]
        heapq.heappush(heap, (-int(sums[0]), tick, sums, ids))
        tick += 1
    groups = []
    for root in heap[0][3].tolist():
        stack, group = [root] if root >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < n:
                group.append(x)
            else:
                stack += [left[x], right[x]]
        groups.append(sorted(group))
    return groups


def fill(groups: list[list[tuple]], pieces: list[tuple], capacity: int) -> None:
    """Pours ``pieces``, cut where need be, into the groups of (document, start, length), the emptiest first, up to a level
    that all of them reach."""
    room = [capacity - sum(p[2] for p in g) for g in groups]
    order = sorted(range(len(groups)), key=lambda k: -room[k])
    left = sum(p[2] for p in pieces)
    for n, k in enumerate(order, 1):  # the level at which the n emptiest take all
        free = room[order[n]] if n < len(order) else 0
        if sum(room[j] - free for j in order[:n]) >= left or n == len(order):
            above, one = divmod(sum(room[j] for j in order[:n]) - left, n)
            break
    queue = list(reversed(pieces))
    for place, k in enumerate(order[:n]):
        take = room[k] - above - (place < one)
        while take > 0:
            doc, start, length = queue.pop()
            cut = min(length, take)
            groups[k].append((doc, start, cut))
            take -= cut
            if cut < length:
                queue.append((doc, start + cut, length - cut))


def pack(pieces: list[tuple], capacity: int = CAPACITY, divisible: float = DIVISIBLE) -> list[list[tuple]]:
    """Windows of pieces (document, start, length), each window at most ``capacity`` long."""
    windows, rest = [], []
    for doc, start, length in pieces:
        while length >= capacity:
            windows.append([(doc, start, capacity)])
            start, length = start + capacity, length - capacity
        if length:
            rest.append((doc, start, length))
    total = sum(p[2] for p in rest)
    rest.sort(key=lambda p: -p[2])
    least = m = -(-total // capacity)
    n = poured = 0
    while m:
        while n < len(rest) and poured < divisible * total:
            poured += rest[n][2]
            n += 1
        whole = rest[n:]
        groups = [[whole[i] for i in g] for g in differencing([p[2] for p in whole], m)]
        if max(sum(p[2] for p in g) for g in groups) <= capacity:
            fill(groups, rest[:n], capacity)
            return windows + [g for g in groups if g]
        m += 1
        if divisible and m > least + 1:  # one window more isn't enough: twice as much is cut
            m, divisible = least, 2 * divisible
    return windows


class _Runs(dict):
    """Token bytes of a run of letters, digits or marks, folded and normalised: one word to the vocabulary's merges."""

    def __init__(self, tok):
        from tokenizers import pre_tokenizers

        self.merge, self.spelled = tok.model.tokenize, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, run: str) -> bytes:
        spelled = run if run.isascii() else self.spelled.pre_tokenize_str(run)[0][0]
        self[run] = out = array("I", [t.id for t in self.merge(spelled)]).tobytes()
        return out


class _Words(dict):
    """Token bytes of a word. The words of the generation before are taken over when they come up again."""

    def __init__(self, tok, runs: _Runs, before: dict):
        self.tok, self.runs, self.before = tok, runs, before

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            runs = self.runs
            if _LATIN(word):
                low = word.lower()
                if low.isalpha():
                    out = runs[low]
                elif low[-1] in ".,!?" and low[:-1].isalpha():
                    out = runs[low[:-1]] + runs[low[-1]]
                else:
                    out = b"".join([runs[r] for r in _RUNS(low)])
            else:
                out = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out


class WordTokens:
    """Token bytes (little-endian uint32) of texts.

    The tokenizer splits at white space, then into runs of letters, digits and marks, and merges inside each run only. So
    words are looked up, new words are split into runs, and only new runs are merged. Words with letters beyond the Latin
    blocks, where normalising can change more than case, and texts with special strings or odd white space go through the
    whole tokenizer. The caches are bounded and live as long as the Python worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = _Words(self.tok, _Runs(self.tok), {})

    def many(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words.runs) > CACHED_WORDS:
            self.words.runs.clear()
        if len(self.words) > CACHED_WORDS:
            self.words = _Words(self.tok, self.words.runs, dict(self.words))
        out, get = [], self.words.__getitem__
        for t in texts:
            if t and ("<|" in t or any(c in t for c in _ODD_SPACE)):
                out.append(array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, (t or "").split())))
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_END = np.array([END_ID], "<u4").tobytes()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, windows: int = WINDOWS, divisible: float = DIVISIBLE, with_ids: bool = True) -> DataFrame:
    """Pieces with their sequence and place in it; ``ids`` holds each piece's ids (little-endian uint32) unless left out."""
    tune_arrow(docs.sparkSession)

    def task(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = word_tokens(tokenizer_path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        bundle, held, room, rows = [], {}, capacity * windows, []

        def place(pieces):
            """Rows of one sequence: pieces (document number, start, length), from the front."""
            nonlocal sequence
            offset = 0
            for key, start, length in pieces:
                doc_id, ids, first, total = held[key]
                part = ids[4 * (start - first) : 4 * (start - first + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), total, sequence, offset, part if with_ids else None))
                offset += length
            sequence += 1

        def close():
            nonlocal bundle, held, room
            for window in pack(bundle, capacity, divisible):
                place(window)
            bundle, held, room = [], {}, capacity * windows

        def flush():
            nonlocal rows
            cols, rows = list(zip(*rows, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        number = 0
        for batch in slices(batches):
            ids_of = tok.many(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids += _END
                total, number = len(ids) // 4, number + 1
                held[number], at = (doc_id, ids, 0, total), total // capacity * capacity
                for start in range(0, at, capacity):  # windows inside the document
                    place([(number, start, capacity)])
                if at == total:
                    del held[number]
                while at < total:
                    take = min(room, total - at)
                    held[number] = (doc_id, ids[4 * at :], at, total)
                    bundle.append((number, at, take))
                    at, room = at + take, room - take
                    if not room:
                        close()
            if rows:
                yield flush()
        if bundle:
            close()
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")
