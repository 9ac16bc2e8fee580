"""Secret scan with a recursive decoding worklist.

Every layer of a text is scanned for three kinds of secrets.  What looks encoded in it
(percent escapes, backslash-u escapes, base64 also over line breaks, zlib and gzip
streams) is unwrapped into a new layer that is scanned and unwrapped in turn.  Escapes
are decoded one by one, so one that is none leaves the others alone; base64 is read from
each of the four places of a run at which it may begin, so a path or word before it does
no harm; bytes that are no UTF-8 are read as Latin-1.  A layer seen before at the same
place is not opened again, so the work ends at a fixpoint.

Spans found in a deeper layer are mapped back to the code points of the original text: to
the characters that encode them, or to the whole stream where it was compressed.  Places are
arrays that each layer composes once with those above it, so any depth works; the time is that of
the layers, one pass over each.  A stream is read in overlapping windows; what would be cut
by them is only a stream inside it whose compressed form is itself longer than OVERLAP.

Defined results: null is the empty text and has no spans; repeated rows give
repeated results; an empty table gives an empty result; other columns pass through, and an added column whose
name is taken ends in an underscore.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.llm.common import free, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A text without any of these has no assignment.
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BACKSLASH = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
#: The shortest secret has 12 bytes and so 16 characters of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Lines of base64, each going on with the next; a run is tried from its beginning alone and whole.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++")
#: How a gzip stream and a zlib stream (window of 32 KB, no dictionary) begin.
STREAM = re.compile("\x1f\x8b\x08|x[\x01^\x9c\xda]")
STREAM_BYTES = re.compile(STREAM.pattern.encode("latin-1"))
NO_BYTE = re.compile("[^\x00-\xff]")
CHUNK = 1 << 16
#: A larger stream is read in windows of so many bytes, each beginning OVERLAP bytes before the end of the last.
WINDOW, OVERLAP = 32 << 20, 4 << 20

#: A path longer than this is not made longer by deeper layers.
PATH = 1000

#: First characters and ends (exclusive) of what each character of a decoded text came from.
Origin = tuple[np.ndarray, np.ndarray]
#: path step, decoded text, its extent in the layer it came from, its origin there (none: the extent, whole)
Layer = tuple[str, str, tuple[int, int], Callable[[], Origin] | None]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Pieces:
    """Text put together from pieces of a layer, and where its characters came from."""

    def __init__(self):
        self.text, self.size = [], 0
        self.at, self.source, self.width = [], [], []  # per piece; width 0: character by character

    def add(self, text: str, source: int, width: int = 0) -> None:
        if text:
            self.text.append(text)
            self.at.append(self.size)
            self.source.append(source)
            self.width.append(width)
            self.size += len(text)

    def extent(self) -> tuple[int, int]:
        return self.source[0], self.source[-1] + (self.width[-1] or self.size - self.at[-1])

    def origin(self) -> Origin:
        at, source, width = (np.array(x, np.int64) for x in (self.at, self.source, self.width))
        piece = np.repeat(np.arange(len(at)), np.diff(np.append(at, self.size)))
        lo = source[piece] + np.where(width[piece] == 0, np.arange(self.size) - at[piece], 0)
        return lo, np.where(width[piece] == 0, lo + 1, source[piece] + width[piece])


class Origins:
    """Where a layer's characters stand in the original text, worked out once and only if something asks.

    A layer asks when it is scanned, after the one above it did, so nothing nests.
    """

    def __init__(self, above: Origins | None, extent: tuple[int, int], local: Callable[[], Origin] | None):
        self.above, self.local, self.lo = above, local, None
        self.whole = local is None or (above is not None and above.whole)
        self.extent = above.place(*extent) if above is not None else extent

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.whole:
            return self.extent
        if self.lo is None:
            lo, hi = self.local()
            above = self.above
            self.lo, self.hi = (lo, hi) if above is None or isinstance(above, Text) else (above.lo[lo], above.hi[hi - 1])
            self.above = self.local = None
        return int(self.lo[a]), int(self.hi[b - 1])


class Text(Origins):
    """The original text itself."""

    def __init__(self):
        self.whole = False

    def place(self, a: int, b: int) -> tuple[int, int]:
        return a, b


def _utf8(raw: bytes) -> Iterator[tuple[str, int]]:
    """(character, bytes) of raw; a byte that begins no character stands for itself (Latin-1)."""
    at = 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            yield raw[at : at + n].decode(), n
        except UnicodeDecodeError:
            n = 1
            yield chr(raw[at]), n
        at += n


def _percent(layer: str) -> Iterator[Layer]:
    """The layer with its percent escapes decoded: as UTF-8, and byte by byte if a stream may begin in it."""
    found = list(PERCENT.finditer(layer))
    if not found:
        return
    for as_bytes in (False, True):
        out, end = Pieces(), 0
        for m in found:
            out.add(layer[end : m.start()], end)
            at, raw = m.start(), bytes.fromhex(m[0].replace("%", ""))
            for c, n in ((chr(x), 1) for x in raw) if as_bytes else _utf8(raw):
                out.add(c, at, 3 * n)
                at += 3 * n
            end = m.end()
        out.add(layer[end:], end)
        text = "".join(out.text)
        if not as_bytes or STREAM.search(text):
            yield "url", text, out.extent(), out.origin


def _backslash(layer: str) -> Iterator[Layer]:
    """The layer with its backslash-u escapes decoded; half a surrogate pair stays as it is."""
    out, end = Pieces(), 0
    for m in BACKSLASH.finditer(layer):
        out.add(layer[end : m.start()], end)
        units, at = [int(x, 16) for x in m[0].split("\\u")[1:]], m.start()
        while units:
            if len(units) > 1 and 0xD800 <= units[0] < 0xDC00 <= units[1] < 0xE000:
                got, n = chr(0x10000 + (units[0] - 0xD800 << 10) + units[1] - 0xDC00), 2
            elif 0xD800 <= units[0] < 0xE000:
                got, n = layer[at : at + 6], 1
            else:
                got, n = chr(units[0]), 1
            out.add(got, at, 0 if len(got) > 1 else 6 * n)
            units, at = units[n:], at + 6 * n
        end = m.end()
    if end:
        out.add(layer[end:], end)
        yield "unicode", "".join(out.text), out.extent(), out.origin


def _base64_runs(layer: str) -> Iterator[tuple[str, Callable[[np.ndarray], np.ndarray]]]:
    """Every run of base64, and where its characters stand; then lines that go on with the next, joined."""
    for m in BASE64.finditer(layer):
        yield m[0], lambda at, s=m.start(): s + at
    if "\n" in layer:
        for m in WRAPPED.finditer(layer):
            out = Pieces()
            for x in re.finditer(r"\S+", m[0]):
                out.add(x[0], m.start() + x.start())
            yield "".join(out.text), lambda at, out=out: out.origin()[0][at]


def _base64(layer: str) -> Iterator[Layer]:
    for run, place in _base64_runs(layer):
        plain = run.replace("-", "+").replace("_", "/")
        for first in range(4):
            size = len(plain) - first
            size -= size % 4 == 1
            raw = base64.b64decode(plain[first : first + size] + "=" * (-size % 4))

            def bits(a: np.ndarray, b: np.ndarray, first=first, place=place) -> Origin:
                """The characters that hold bytes a to b."""
                return place(first + a * 4 // 3), place(first + (8 * b - 1) // 6) + 1

            def of_text(text: str, bits=bits) -> Origin:
                ends = np.arange(1, len(text) + 1)
                if not text.isascii():
                    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    ends = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
                return bits(np.append(0, ends[:-1]), ends)

            if not raw:
                continue
            lo, hi = bits(np.array([0]), np.array([len(raw)]))
            extent = int(lo[0]), int(hi[0])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = None
            if text is not None:
                yield "base64", text, extent, lambda text=text, of_text=of_text: of_text(text)
            if text is None or not text.isascii() and STREAM_BYTES.search(raw):
                yield "base64", raw.decode("latin-1"), extent, lambda n=len(raw), bits=bits: bits(np.arange(n), np.arange(1, n + 1))


def _inflated(layer: str, at: int) -> Iterator[bytes | int]:
    """The bytes of the stream that begins at a character (each stands for one byte), piece by piece, and last where it ends; no end if it breaks off."""
    engine, size = zlib.decompressobj(31 if layer[at] == "\x1f" else 15), 32
    while at < len(layer):
        piece, size = layer[at : at + size], min(2 * size, CHUNK)
        last = NO_BYTE.search(piece)
        piece = piece[: last.start()] if last else piece
        raw = piece.encode("latin-1")
        at += len(piece)
        try:
            while raw and not engine.eof:
                yield engine.decompress(raw, WINDOW)
                raw = engine.unconsumed_tail
        except zlib.error:
            return
        if engine.eof:
            yield at - len(engine.unused_data)
            return
        if last:
            return


def _windows(layer: str, at: int) -> Iterator[bytes]:
    """A stream's bytes in windows that overlap, so that no more than one is held."""
    held = bytearray()
    for piece in _inflated(layer, at):
        if isinstance(piece, int):
            break
        held += piece
        while len(held) >= 2 * WINDOW:
            yield bytes(held[:WINDOW])
            del held[: WINDOW - OVERLAP]
    yield bytes(held)


def _readings(raw: bytes) -> Iterator[str]:
    """Bytes as UTF-8 if they are (a window may cut a character at either end), and as Latin-1 if not or if a stream may begin in them."""
    lead = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), 0) if len(raw) >= WINDOW else 0
    text = None
    for cut in range(4 if len(raw) >= WINDOW else 1):
        try:
            text = raw[lead : len(raw) - cut].decode()
            break
        except UnicodeDecodeError:
            pass
    if text is not None:
        yield text
    if text is None or not text.isascii() and STREAM_BYTES.search(raw):
        yield raw.decode("latin-1")


def _streams(layer: str) -> Iterator[Layer]:
    end = 0
    for m in STREAM.finditer(layer):
        if m.start() < end:
            continue
        over = next((x for x in _inflated(layer, m.start()) if isinstance(x, int)), None)
        if over is not None:
            end = over
            for raw in _windows(layer, m.start()):
                for text in _readings(raw):
                    yield "zip", text, (m.start(), end), None


def unwrapped(layer: str) -> Iterator[Layer]:
    """Every layer that one step of decoding finds in a layer."""
    if "%" in layer:
        yield from _percent(layer)
    if "\\u" in layer:
        yield from _backslash(layer)
    yield from _base64(layer)
    if "x" in layer or "\x1f" in layer:
        yield from _streams(layer)


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, path): path tells the layers that were opened, empty for the text itself."""
    text = text or ""
    found = {span: "" for span in base_spans(text)}
    seen = {(_digest(text), 0, len(text))}
    work: list[tuple[str, Origins, str]] = [(text, Text(), "")]
    while work:
        layer, above, path = work.pop()
        for how, inner, extent, local in unwrapped(layer):
            if not inner:
                continue
            origins = Origins(above, extent, local)
            mark = (_digest(inner), *origins.extent)
            if mark in seen:
                continue
            seen.add(mark)
            deeper = f"{path}/{how}" if path and len(path) < PATH else how if not path else path
            for k, a, b in base_spans(inner):
                found.setdefault((k, *origins.place(a, b)), deeper)
            work.append((inner, origins, deeper))
    return sorted(((k, a, b, p) for (k, a, b), p in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("path", T.StringType())]))


def find_secrets(docs: DataFrame, *, text_col="text", out_col="secrets") -> DataFrame:
    """docs with an array of (kind, start, end, path) in out_col."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "path"), x)) for x in scan(t)])

    return docs.withColumn(free(docs, out_col)[0], spans(F.col(text_col).cast("string")))


def redact(docs: DataFrame, *, text_col="text", mask="[secret]") -> DataFrame:
    """docs whose texts have every found span replaced by `mask`; null texts stay null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, mask))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def masked(text: str | None, mask: str) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for _, a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(found: DataFrame, *, id_col="doc_id", spans_col="secrets") -> DataFrame:
    """The contract's columns of find_secrets()'s rows."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(spans_col, lambda x: x["path"] == "")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col,
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.col(spans_col), said), ",").alias("spans"),
        F.size(F.filter(spans_col, lambda x: x["path"] != "")).cast("long").alias("n_decoded"),
    )
