"""Secret scans with a recursive decoding worklist.

A text is layer 0. Every layer is scanned with the base patterns; then its URL escapes are decoded, its Unicode and
character escapes are decoded, and each base64 run is decoded, also through compressed streams (gzip, zlib, bzip2, xz,
zstd). Decoded bytes needn't be text: what isn't UTF-8 is scanned as Latin-1, and as UTF-16 where NULs alternate; each
result is a new layer on the worklist, until nothing new appears. Base64 that is wrapped over lines is read as a whole, too.
A layer that was seen before in this text (by digest) isn't taken again, so cycles end. Every character of a layer knows its span in the
original text: exact for escapes, the whole run for base64 that is text as a whole and for compressed layers, the
characters that encode it for what lies elsewhere in a base64 run. Runs are decoded in all four alignments, and streams
are tried at their start and behind each '/', '-', '_' and '+': paths before a payload and joined payloads hide nothing. The spans found in deeper layers
are added to the base ones. Behind ``LEVELS`` layers of escapes the rest of a nest is unwrapped at once, to its innermost text,
so that a nest as deep as the text is long takes time in proportion.

Streams are decompressed over all their members or frames in pieces of ``PIECE`` bytes, each scanned before the next is
made, so neither size nor number of layers is bounded and memory is. They may begin anywhere in decoded base64 or in bytes
written with URL or character escapes; inside another stream, at its start. Pieces end where no pattern reaches across.

Limits: where a decompressed layer has no such place (a line break, a control or non-ASCII character) for ``MAX_LAYER``
bytes, the pieces overlap by ``OVERLAP``; zstd windows and xz memory above ``MAX_LAYER`` (xz: four times) aren't opened, and
streams nest 64 deep at most. Edge cases: null and empty texts have no spans; repeated rows are scanned alike, a null doc_id
like any other; spans of equal start are in the order of kinds; empty tables give no rows; other columns are ignored; runs
that aren't base64 are left as they are.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tune_arrow

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
PIECE = 1 << 20
OVERLAP = 1 << 16
LEVELS = 8
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_HINTS = ("passw", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}+(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]{16,}+={0,2}+)++(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]{1,15}+={0,2}+(?!=))?")
_LINE_END = re.compile(r"[\x20\t]*\r?\n[\x20\t>]*")
_BREAK = re.compile(rb"[\x01-\x08\x0e-\x1f\x7f-\xff]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78](?=[\s\S])")
_MARK = re.compile(r"%[0-9A-Fa-f]{2}|\\[xu]|&#")
_URL_RUN = re.compile(r"[!#-;=?-\[\]-~]+")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[\s\S]")
_ESCAPE_RUN = re.compile(r"[\x20-\x7e]+")
_ESCAPE_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|&#x0{0,4}([0-9A-Fa-f]{1,2});|&#0{0,4}(2[0-4][0-9]|25[0-5]|1[0-9]{2}|[0-9]{1,2});|\\([abfnrtv0\\'\"])|[\s\S]")
_SHORT = dict(zip("abfnrtv0", (7, 8, 12, 10, 13, 9, 11, 0)))
_SOME = re.compile(rb"[\x20-\x7e]{16}")  # no find, and nothing that decodes to one, is shorter
_WIDE = (re.compile(rb"(?:[\t\r\n\x20-\x7e]\0){16,}"), re.compile(rb"(?:\0[\t\r\n\x20-\x7e]){16,}"))
_PLAIN = re.compile(r"[A-Za-z]{1,19}\Z|[a-z]+\Z|[A-Z]?[a-z]+\Z|[A-Z]+\Z|[0-9a-f]+\Z")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Layer:
    """A text, with the span in the original text of each of its characters (None: the identity, or one span for all)."""

    __slots__ = ("text", "start", "end", "whole", "path")

    def __init__(self, text, start=None, end=None, whole=None, path=()):
        self.text, self.start, self.end, self.whole, self.path = text, start, end, whole, path

    def span(self, s: int, e: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.start is None:
            return s, e
        return int(self.start[s]), int(self.end[e - 1])


def _rewritten(layer: Layer, pieces: list[tuple[int, int, str]], how: str) -> Layer:
    """The layer with [s, e) replaced by each piece's text."""
    parts, starts, ends, at = [], [], [], 0
    n = len(layer.text)
    if not layer.whole:
        here_s = np.arange(n) if layer.start is None else layer.start
        here_e = np.arange(1, n + 1) if layer.end is None else layer.end
    for s, e, new in [*pieces, (n, n, "")]:
        parts += [layer.text[at:s], new]
        if not layer.whole:
            starts += [here_s[at:s], np.full(len(new), here_s[s] if s < n else 0)]
            ends += [here_e[at:s], np.full(len(new), here_e[e - 1] if e else 0)]
        at = e
    if layer.whole:
        return Layer("".join(parts), whole=layer.whole, path=(*layer.path, how))
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), path=(*layer.path, how))


def _url(layer: Layer) -> Layer | None:
    pieces = []
    for m in _URL.finditer(layer.text):
        raw = binascii.unhexlify(m[0].replace("%", ""))
        try:
            new = raw.decode()
        except UnicodeDecodeError:
            new = raw.decode("latin-1")
        if len(new) == len(raw):  # a character per escape: keep each escape's own span
            pieces += [(m.start() + 3 * i, m.start() + 3 * i + 3, c) for i, c in enumerate(new)]
        else:
            pieces.append((*m.span(), new))
    return _rewritten(layer, pieces, "url") if pieces else None


def _escapes(layer: Layer) -> Layer | None:
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        code = int(next(g for g in m.groups()[:5] if g), 16) if m[6] is None else int(m[6])
        if code > 0x10FFFF:
            continue
        if 0xDC00 <= code < 0xE000 and pieces and pieces[-1][1] == m.start() and len(pieces[-1][2]) == 1 and 0xD800 <= ord(pieces[-1][2]) < 0xDC00:
            s, _, high = pieces.pop()
            pieces.append((s, m.end(), chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00)))
        else:
            pieces.append((*m.span(), chr(code)))
    return _rewritten(layer, pieces, "escape") if pieces else None


_HEXES = frozenset("0123456789abcdefABCDEF")


def _escape_at_end(out: list[str]) -> tuple[int, int, bool] | None:
    """(length, code, whether it is a byte) of the escape that the last characters of ``out`` are, if any."""
    c = out[-1]
    if c in _HEXES:
        for mark, size in (("%", 2), ("\\x", 2), ("\\u", 4), ("\\U", 8)):
            n = len(mark) + size
            if len(out) >= n and out[-n] == mark[0] and (len(mark) == 1 or out[-n + 1] == mark[1]) and all(x in _HEXES for x in out[-size:]):
                return n, int("".join(out[-size:]), 16), mark == "%"
    elif c in "};":
        tail = "".join(out[-11:])
        if m := _LAST.search(tail):
            return len(m[0]), int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3]), False
    return None


_LAST = re.compile(r"(?:\\u\{([0-9A-Fa-f]{1,6})\}|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});)\Z")


def _settled(layer: Layer) -> Layer:
    """The layer with all escapes decoded, and what they decode to, until none is left: one pass with a stack."""
    out: list[str] = []
    first: list[int] = []
    raw: list[bool] = []  # a byte above 127, which may be part of a character
    last: list[int] = []
    for k, c in enumerate(layer.text):
        out.append(c)
        first.append(k)
        last.append(k)
        raw.append(False)
        while (got := _escape_at_end(out)) and got[1] <= 0x10FFFF:
            n, code, byte = got
            out[-n:], first[-n:], last[-n:], raw[-n:] = [chr(code)], [first[-n]], [k], [byte and code > 127]
    at = 0
    while at < len(out):
        end = at
        while end < len(out) and raw[end]:
            end += 1
        if end > at:
            try:
                text = bytes(map(ord, out[at:end])).decode()
                out[at:end], first[at:end], last[at:end], raw[at:end] = list(text), [first[at]] * len(text), [last[end - 1]] * len(text), [False] * len(text)
                end = at + len(text)
            except UnicodeDecodeError:
                pass
        at = end + 1
    path = (*layer.path, "settled")
    if layer.whole:
        return Layer("".join(out), whole=layer.whole, path=path)
    s, e = np.array(first, np.int64), np.array(last, np.int64)
    return Layer("".join(out), s if layer.start is None else layer.start[s], e + 1 if layer.end is None else layer.end[e], path=path)


def _opened(head: bytes):
    """(name, a new decompressor) for the header of a stream."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 0x0F == 8 and head[0] >> 4 <= 7 and int.from_bytes(head[:2]) % 31 == 0):
        return "zlib", zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor(memlimit=MAX_LAYER * 4)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor(max_window_size=MAX_LAYER).decompressobj()
    return None


def _members(chunks, used: list | None = None):
    """Decompressed pieces of about a PIECE of all members or frames, up to a fault; then what follows them, as it is.
    ``used`` gets the bytes that the members took."""
    chunks, data, taken = iter(chunks), b"", 0
    while True:
        while len(data) < 6 and (more := next(chunks, None)) is not None:
            data += more
        if (got := _opened(data)) is None:
            break
        name, d = got
        try:
            while not d.eof:
                if name == "zstd":  # has no bound on its output: 128 KB for 4 bytes at most
                    if not data and not (data := next(chunks, b"")):
                        return
                    part, data = data[:64], data[64:]
                    out = d.decompress(part)
                    taken += len(part)
                else:
                    out = d.decompress(data, PIECE)
                    taken += len(data)
                    data = d.unconsumed_tail if name == "zlib" else b""
                    taken -= len(data)
                    if not out and not d.eof and not data and (name == "zlib" or d.needs_input) and not (data := next(chunks, b"")):
                        return
                if out:
                    yield out
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return
        taken -= len(d.unused_data)
        data = d.unused_data + data
        if used is not None:
            used[:] = [taken]
    if used is None:  # inside a stream: what isn't a stream is text
        yield data
        yield from chunks


def _nested(chunks, how: tuple, marks: frozenset = frozenset()):
    """(piece, path) of a decompressed stream, through the streams it begins with; a stream met before isn't opened again."""
    chunks, head = iter(chunks), b""
    while len(head) < 1 << 16 and (more := next(chunks, None)) is not None:
        head += more
    mark = hashlib.blake2b(head, digest_size=16).digest()
    if (got := _opened(head)) is not None and mark not in marks and len(how) < 64:
        if next(_members([head]), None):
            yield from _nested(_members(itertools.chain([head], chunks)), (*how, got[0]), marks | {mark})
            return
    yield head, how
    for piece in chunks:
        yield piece, how


def _pieces(parts):
    """(bytes, path) for scanning: cut where no pattern reaches across, and overlapping where there is no such place."""
    held, path = bytearray(), ()
    for piece, how in parts:
        if how != path and held:
            yield bytes(held), path
            held.clear()
        path = how
        held += piece
        if len(held) < PIECE:
            continue
        tail = max(held.rfind(b"\n"), held.rfind(b"\0\0"), max((m.start() for m in _BREAK.finditer(held, len(held) - 4096)), default=-1)) + 1
        if tail:
            yield bytes(held[:tail]), path
            del held[:tail]
        elif len(held) >= MAX_LAYER:
            yield bytes(held), path
            del held[:-OVERLAP]
    if held:
        yield bytes(held), path


def _streams(raw: bytes, span, path: tuple, read: list | None = None):
    """The texts in the streams that begin anywhere in ``raw``; ``span`` gives the span from a byte to the end, and
    ``read`` gets the bytes of whole streams."""
    at = 0
    while m := _MAGIC.search(raw, at):
        at = m.start() + 1
        if (got := _opened(raw[m.start() : m.start() + 6])) is None:
            continue
        used: list = []
        mark = hashlib.blake2b(raw[m.start() : m.start() + (1 << 16)], digest_size=16).digest()
        source = (raw[k : k + PIECE] for k in range(m.start(), len(raw), PIECE))
        for piece, how in _pieces(_nested(_members(source, used), (got[0],), frozenset([mark]))):
            if b"\0" in piece or _SOME.search(piece):
                for text in _texts(piece):
                    yield Layer(text, whole=span(m.start()), path=path + how)
        if used:
            at = m.start() + used[0]
            if read is not None:
                read.append((m.start(), at))


def _written_bytes(layer: Layer):
    """Streams whose bytes are written with URL or character escapes, other characters standing for themselves."""
    for runs, tokens in ((_URL_RUN, _URL_BYTE), (_ESCAPE_RUN, _ESCAPE_BYTE)):
        for run in runs.finditer(layer.text):
            if sum(1 for _ in itertools.islice(_MARK.finditer(run[0]), 4)) < 4:  # a stream has more bytes to escape
                continue
            found = [*tokens.finditer(run[0])]
            raw = bytearray()
            for t in found:
                code = next((g for g in t.groups()[:5] if g), None)
                if tokens is _URL_BYTE:
                    raw.append(int(t[1], 16) if t[1] else 32 if t[0] == "+" else ord(t[0]))
                elif code:
                    raw.append(int(code, 16) & 255)
                elif t[6]:
                    raw.append(int(t[6]) & 255)
                else:
                    raw.append(_SHORT.get(t[7], ord(t[7])) if t[7] else ord(t[0]))
            starts = [run.start() + t.start() for t in found]
            yield from _streams(bytes(raw), lambda k, starts=starts, end=run.end(): layer.span(starts[k], end), (*layer.path, "url" if tokens is _URL_BYTE else "escape"))


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if not c.isprintable() and c not in "\t\r\n")
    return text if text and odd * 20 <= len(text) else None


def _wide(raw: bytes):
    if b"\0" in raw:
        for wide in _WIDE:
            if text := "\n".join(m[0].replace(b"\0", b"").decode() for m in wide.finditer(raw)):
                yield text


def _texts(raw: bytes):
    """What there is to scan in decoded bytes: UTF-8 or else Latin-1 (the patterns are ASCII), and UTF-16 where NULs alternate."""
    if not raw:
        return
    try:
        yield raw.decode()
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    yield from _wide(raw)


def _mapped(layer: Layer, raw: bytes, at: int, path: tuple) -> Layer:
    """Bytes of the base64 that begins at ``at`` as Latin-1, each with the characters that encode it."""
    text = raw.decode("latin-1")
    if layer.whole:
        return Layer(text, whole=layer.whole, path=path)
    bits = np.arange(len(raw)) * 8
    first, last = at + bits // 6, at + (bits + 13) // 6
    return Layer(text, first if layer.start is None else layer.start[first], last if layer.end is None else layer.end[last - 1], path=path)


def _wrapped(layer: Layer):
    """Base64 over several lines, as mail and keys have it, without its line ends."""
    for m in _LINES.finditer(layer.text):
        inner = [(x.start(), x.end(), "") for x in _LINE_END.finditer(layer.text, *m.span())]
        if inner:
            part = Layer(m[0], layer.start, layer.end, layer.whole, layer.path)
            if not layer.whole:
                k = np.arange(*m.span())
                part.start, part.end = (k, k + 1) if layer.start is None else (layer.start[k], layer.end[k])
            yield _rewritten(part, [(s - m.start(), e - m.start(), new) for s, e, new in inner], "lines")


def _base64(layer: Layer):
    """Each run in its four alignments: a payload behind a '/', '-', '_' or '+' begins at a character of one of them.

    A run that is text or a stream as a whole has its own span; what lies in a run is mapped to the characters that
    encode it, so that several payloads in a run keep their own spans.
    """
    for m in _BASE64.finditer(layer.text):
        if _PLAIN.match(m[0]):  # a word, a number in hex: not mixed enough for base64 of 12 bytes
            continue
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):
            part = body[skip:]
            part = part[:-1] if len(part) % 4 == 1 else part
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            at = m.start() + skip
            path = (*layer.path, "base64")
            at_once = not skip and _readable(raw) is not None
            if at_once:
                for text in _texts(raw):
                    yield Layer(text, whole=layer.span(*m.span()), path=path)
            for text in _wide(raw):
                yield Layer(text, whole=layer.span(at, m.end()), path=path)
            read: list = []
            yield from _streams(raw, lambda k, at=at, m=m: layer.span(at + k * 8 // 6, m.end()), path, read)
            if not at_once:
                for s, e in read:  # found in the stream, not again in its stored bytes
                    raw = raw[:s] + bytes(e - s) + raw[e:]
                if _SOME.search(raw):
                    yield _mapped(layer, raw, at, path)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple]]:
    """(base spans, all spans, deeper finds as (span, layer path, secret text))."""
    base = ordered(scan(text))
    spans, deep = dict.fromkeys(base), []
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()} if "%" in text or "\\" in text or "&#" in text else set()
    work = [iter([Layer(text)])]
    while work:  # layers are made one at a time, the deepest first, so that few are held
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if layer.path:
            mark = hashlib.blake2b(f"{layer.whole or layer.span(0, len(layer.text)) if layer.text else ''}{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            for kind, s, e in scan(layer.text):
                span = (kind, *layer.span(s, e))
                if span not in spans:
                    spans[span] = None
                    deep.append((span, layer.path, layer.text[s:e]))
        depth = sum(how in ("url", "escape") for how in layer.path)
        if depth < LEVELS:
            new = [_url(layer) if "%" in layer.text else None, _escapes(layer) if "\\" in layer.text or "&#" in layer.text else None]
        else:
            new = [_settled(layer) if layer.path[-1] != "settled" and _MARK.search(layer.text) else None]
        if any(new):
            work.append(_written_bytes(layer))
        work += [iter([x]) for x in new if x is not None]
        work.append(_base64(layer))
        if layer.path[-1:] != ("lines",):
            work.append(_wrapped(layer))
    return base, ordered(spans), deep


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, decoded array<struct<kind:string,start:long,end:long,layers:string,secret:string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, and what was found in decoded layers."""
    tune_arrow(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string()), ("secret", pa.string())]))

    def task(batches):
        for rows in slices(batches):
            out = [find(t or "") for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array([sum(s[0] == k for s in b) for b, _, _ in out], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _, _ in out]), pa.array([written(a) for _, a, _ in out]),
                 pa.array([len(d) for _, _, d in out], pa.int64()), pa.array([[{"kind": s[0], "start": s[1], "end": s[2], "layers": ">".join(p), "secret": t} for s, p, t in d] for _, _, d in out], kind)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("decoded")
