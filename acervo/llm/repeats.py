"""Removal of byte strings that occur more than once, by distributed suffix sorting.

A window is `size` consecutive bytes of one document; every byte of a window that also
starts anywhere else goes.  Several sizes can be judged in one go: anchors then serve the
smallest windows, with which the larger ones begin, and suffixes reach as far as the largest.  Sorting one suffix for every byte would move the text
hundreds of times over, so suffixes are taken at anchors: each window names the place of its
smallest 16-byte hash, which depends on the window's own bytes alone, so equal windows
name the same place in themselves.  About one byte in `reach` / 2 is an anchor.

Map tasks sort the suffixes at their anchors into runs and front-code them (length of
the prefix shared with the suffix before, then the rest).  Runs are exchanged by
the first bytes that all windows of an anchor have in common.  Each reduce task
merges its runs with a loser tree that holds, for every loser, how many bytes it shares
with the last winner; prefixes known to be equal are never compared again, and the
shared lengths of the merged order come for free.  From them, and from hashes of
the bytes to the left of the anchors, follows for each window whether it has a twin.

The number of parts follows the input's bytes.  A merge holds its runs compressed, one
block of each unpacked, and resolves the suffixes of a neighbourhood (all that begin with the
same GRAM bytes) as soon as the order has left it.

Identical surroundings are collapsed inside a map task before the exchange, so a task
sends one suffix for all copies of a passage; their spans are known at once.  The merge
likewise keeps one suffix of equal ones.

Left contexts are compared by 64-bit hashes; everything else is compared byte by byte.

Defined results: null is the empty text; texts shorter than `size` bytes have no
windows; rows equal in id and text are copies of each other; an empty table gives an
empty result; other columns pass through, and an added column whose name is taken ends in
an underscore.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Scratch, free, shuffle_parts, small_batches

SIZE = 400
#: Fifty words of five bytes: passages that are too short for a window of SIZE bytes are reported, but not removed.
SHORT = 250
GRAM = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Text that a map task turns into one set of sorted runs.
RUN_BYTES = 8 << 20
#: Documents' bytes that are hashed together.
CHUNK = 2 << 20
#: Input bytes for each part; suffixes in a block of a run; suffixes that are resolved together, if no neighbourhood is cut.
PART_BYTES, BLOCK, TOGETHER = 32 << 20, 4096, 20_000


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each position on (the last ones wrap and are not used)."""
    h, n = text.astype(np.uint64) + np.uint64(1), 1
    power = BASE
    while n < GRAM:
        h = h * power + np.concatenate([h[n:], h[:n]])
        power, n = _times(power, power), 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i : i + width] for each i."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(texts: list[bytes], size: int = SIZE) -> Iterator[tuple[int, int, int, int]]:
    """(text, anchor, first, last): the windows that start from first to last name this anchor."""
    reach = size - GRAM + 1
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= CHUNK):
            total += len(texts[end])
            end += 1
        joined = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        bounds = np.cumsum([0, *map(len, texts[at:end])])
        if total >= size:
            named = (_window_min(_gram_hashes(joined) << np.uint64(32) | np.arange(total, dtype=np.uint64), reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                if b - a >= size:
                    own = named[a : b - size + 1] - a
                    turn = np.flatnonzero(np.diff(own)) + 1
                    firsts = [0, *turn.tolist()]
                    for first, last, anchor in zip(firsts, [*(turn - 1).tolist(), len(own) - 1], own[firsts].tolist()):
                        yield at + k, anchor, first, last
        at = end


def encode_run(rows: list[tuple[bytes, bytes, int, int, int, bool]]) -> bytes:
    """Sorted (right, left, key, key, anchor, copied) as a front-coded run of compressed blocks."""
    out, before = [], b""
    for at in range(0, len(rows), BLOCK):
        own, shared = rows[at : at + BLOCK], []
        for r in own:
            shared.append(common(before, r[0], 0))
            before = r[0]
        rest = b"".join(r[0][s:] for r, s in zip(own, shared))
        left = b"".join(r[1] for r in own)
        lengths = np.array([shared, [len(r[0]) - s for r, s in zip(own, shared)], [len(r[1]) for r in own]], "<u4").tobytes()
        refs = np.array([[r[2] for r in own], [r[3] for r in own], [r[4] for r in own], [r[5] for r in own]], "<i8").tobytes()
        block = zstandard.ZstdCompressor(level=3).compress(struct.pack("<II", len(own), len(rest)) + lengths + refs + rest + left)
        out += [struct.pack("<I", len(block)), block]
    return b"".join(out)


class Run:
    """Reads a run suffix by suffix: right, shared (with the suffix before), left and ref."""

    def __init__(self, blob: bytes):
        self.blob, self.next, self.n, self.at = blob, 0, 0, -1
        self.right: bytes | None = b""
        self.step()

    def _open(self) -> None:
        (size,) = struct.unpack_from("<I", self.blob, self.next)
        raw = zstandard.ZstdDecompressor().decompress(self.blob[self.next + 4 : self.next + 4 + size])
        self.next += 4 + size
        n, size = struct.unpack_from("<II", raw)
        lengths = np.frombuffer(raw, "<u4", 3 * n, 8).reshape(3, n).astype(np.int64)
        self.refs = np.frombuffer(raw, "<i8", 4 * n, 8 + 12 * n).reshape(4, n).T.tolist()
        rest = 8 + 12 * n + 32 * n
        self.rests = (rest + np.concatenate([[0], np.cumsum(lengths[1])])).tolist()
        self.lefts = (rest + size + np.concatenate([[0], np.cumsum(lengths[2])])).tolist()
        self.sharing, self.raw, self.n, self.at = lengths[0].tolist(), raw, n, 0

    def step(self) -> None:
        self.at += 1
        if self.at >= self.n:
            if self.next == len(self.blob):
                self.right = None
                return
            self._open()
        self.shared = self.sharing[self.at]
        self.right = self.right[: self.shared] + self.raw[self.rests[self.at] : self.rests[self.at + 1]]

    def ref(self) -> list[int]:
        return self.refs[self.at]

    def left(self) -> bytes:
        return self.raw[self.lefts[self.at] : self.lefts[self.at + 1]]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : min(n, known + 32)], b[known : min(n, known + 32)]
        if x != y:
            return known + (8 * len(x) - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
        known += 32
    return n


def merged(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """The runs' suffixes in order, each with the bytes it shares with the one before; the run stands on it.

    A tree of losers: node i holds the run that lost there and the bytes its suffix
    shares with the last overall winner.  Of two suffixes, the one that shares
    more with that winner is smaller; only where both share equally many are bytes compared,
    and only those beyond.
    """
    wide = 1
    while wide < len(runs):
        wide *= 2
    runs = [*runs, *[None] * (wide - len(runs))]

    def play(x, sx, y, sy):
        """Winner and what it shares, loser and what it shares (with the winner, if bytes were compared)."""
        if x is None or x.right is None:
            return y, sy, x, sx
        if y is None or y.right is None or sx > sy:
            return x, sx, y, sy
        if sx < sy:
            return y, sy, x, sx
        both = common(x.right, y.right, sx)
        a, b = x.right, y.right
        if a[both : both + 1] <= b[both : both + 1]:
            return x, sx, y, both
        return y, sy, x, both

    losers: list = [None] * wide
    shares = [0] * wide
    level = [(r, 0) for r in runs]
    at = wide
    while len(level) > 1:
        at //= 2
        above = []
        for i in range(0, len(level), 2):
            w, sw, lo, sl = play(*level[i], *level[i + 1])
            losers[at + i // 2], shares[at + i // 2] = lo, sl
            above.append((w, sw))
        level = above
    leaf = {id(r): wide + i for i, r in enumerate(runs) if r is not None}
    winner, shared = level[0]
    while winner is not None and winner.right is not None:
        yield winner, shared
        node = leaf[id(winner)] >> 1
        winner.step()
        shared = winner.shared if winner.right is not None else 0
        while node:
            winner, shared, losers[node], shares[node] = play(winner, shared, losers[node], shares[node])
            node >>= 1


def twins(rights: list[bytes], lefts: list[bytes], shared: np.ndarray, copied: np.ndarray, size: int = SIZE) -> dict[int, list[tuple[int, int]]]:
    """For suffixes in sorted order, the windows (bytes left of the anchor, as closed ranges) that have a twin.

    copied: the suffix stands for several places already.
    """
    least = np.array([max(0, size - len(r)) for r in rights])
    most = np.array([len(x) for x in lefts])
    near = np.maximum(shared, np.append(shared[1:], 0))
    maybe = np.flatnonzero(((near >= size - most) | copied) & (least <= most))
    kinds: dict[tuple[bytes, bytes], list[int]] = {}
    for i in maybe.tolist():
        kinds.setdefault((rights[i], lefts[i]), []).append(i)
    found: dict[int, list[tuple[int, int]]] = {}
    first, done = [], []
    for places in kinds.values():
        whole = len(places) > 1 or bool(copied[places[0]])
        if whole:
            for i in places:
                found[i] = [(int(least[i]), int(most[i]))]
        first.append(places[0])
        done.append(whole)
    order = np.argsort(first)
    own, whole = np.array(first, np.int64)[order], np.array(done, bool)[order]
    if not len(own) or whole.all():
        return found
    # bytes shared with the kind before: the least on the way there
    ranges = np.stack([own[:-1] + 1, own[1:] + 1], 1).ravel()
    between = np.minimum.reduceat(np.append(shared, 0), ranges)[::2] if len(own) > 1 else np.zeros(0, np.int64)
    link = np.concatenate([[0], between])
    # only neighbourhoods with an open kind
    group = np.cumsum(link < GRAM)
    busy = np.isin(group, group[~whole]) & (np.bincount(group)[group] > 1)
    own, whole, link, group = own[busy], whole[busy], link[busy], group[busy]
    if not len(own):
        return found
    link[np.concatenate([[True], group[1:] != group[:-1]])] = 0
    lo, hi = least[own], most[own]
    back = np.zeros((int(hi.max()), len(own)), np.uint8)
    for j, i in enumerate(own.tolist()):
        x = lefts[i]
        back[: len(x), j] = np.frombuffer(x, np.uint8)[::-1]
    hashes, power = np.zeros(len(own), np.uint64), BASE
    hits: dict[int, list[int]] = {}
    for d in range(int(hi.max()) + 1):
        if d:
            hashes += (back[d - 1].astype(np.uint64) + np.uint64(1)) * power
            power = _times(power, BASE)
        live = np.flatnonzero((lo <= d) & (d <= hi))
        if len(live) < 2:
            continue
        name = np.cumsum(link < size - d).astype(np.uint64)[live] * np.uint64(0xD6E8FEB86659FD93) ^ hashes[live]
        _, back_to, count = np.unique(name, return_inverse=True, return_counts=True)
        for j in live[(count[back_to] > 1) & ~whole[live]].tolist():
            hits.setdefault(int(own[j]), []).append(d)
    for i, ds in hits.items():
        cut = [0, *(np.flatnonzero(np.diff(ds) > 1) + 1).tolist(), len(ds)]
        found[i] = [(ds[a], ds[b - 1]) for a, b in zip(cut, cut[1:])]
    return found


SPANS = "k1 long, k2 long, size long, start long, end long"
NAMES = ["k1", "k2", "size", "start", "end"]
ARROW = pa.schema([("part", pa.int32()), ("run", pa.binary()), *[(n, pa.int64()) for n in NAMES]])


def _runs(batches, parts: int, sizes: tuple[int, ...]):
    """Map side: front-coded runs for each part, and spans that copies inside the task prove already."""
    keys: list[tuple[int, int]] = []
    texts: list[bytes] = []
    held = 0

    def flush():
        nonlocal keys, texts, held
        kinds: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for i, anchor, first, last in anchors(texts, min(sizes)):
            t = texts[i]
            kinds.setdefault((t[anchor : last + max(sizes)], t[first:anchor]), []).append((i, anchor))
        known, by = [], {}
        for (right, left), places in kinds.items():
            i, anchor = places[0]
            by.setdefault(crc32(right[:GRAM]) % parts, []).append((right, left, *keys[i], anchor, len(places) > 1))
            if len(places) > 1:
                known += [(*keys[j], size, a - len(left), a + len(right)) for j, a in places for size in sizes if size <= len(left) + len(right)]
        del kinds
        for part, rows in by.items():
            rows.sort()
            yield pa.RecordBatch.from_pydict({"part": [part], "run": [encode_run(rows)], **{n: [None] for n in NAMES}}, schema=ARROW)
        spans = joined(known)
        for at in range(0, len(spans), 10_000):
            s = spans[at : at + 10_000]
            # dealt out by themselves: copies of one passage must not meet in one task
            yield pa.RecordBatch.from_arrays([pa.array((s[:, 0] % parts).astype(np.int32)), pa.nulls(len(s), pa.binary()), *[pa.array(s[:, c]) for c in range(5)]], schema=ARROW)
        keys, texts, held = [], [], 0

    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            if text is not None and len(text) >= min(sizes):
                keys.append((k1, k2))
                texts.append(text)
                held += len(text)
                if held >= RUN_BYTES:
                    yield from flush()
    if texts:
        yield from flush()


def joined(spans: list[tuple[int, ...]]) -> np.ndarray:
    """Rows (k1, k2, size, start, end) with overlapping or touching spans of a document made one."""
    out: list[list[int]] = []
    for row in sorted(spans):
        if out and out[-1][:3] == list(row[:3]) and row[3] <= out[-1][4]:
            out[-1][4] = max(out[-1][4], row[4])
        else:
            out.append(list(row))
    return np.array(out, np.int64).reshape(-1, 5)


def resolved(runs: list[Run], sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Spans (key, key, size, start, end) of the windows with a twin, of all runs of one part."""
    rights, lefts, shared, refs, whole, spans = [], [], [], [], [], []
    places: dict[tuple[bytes, bytes], int] = {}
    link = 0  # bytes shared with the suffix that was kept last

    def close():
        for size in sizes:
            found = twins(rights, lefts, np.array(shared, np.int64), np.array(whole, bool), size)
            for i, ds in found.items():
                k1, k2, anchor, copied = refs[i]
                if not copied:  # else its spans are known
                    spans.extend((k1, k2, size, anchor - b, anchor - a + size) for a, b in ds)
        for kept in (rights, lefts, shared, refs, whole, places):
            kept.clear()

    for run, s in merged(runs):
        if s < GRAM:
            if len(rights) >= TOGETHER:
                close()
                yield joined(spans)
                spans.clear()
            places.clear()
        link = min(link, s)
        right, left, ref = run.right, run.left(), run.ref()
        at = places.setdefault((right, left), len(rights))
        if at < len(rights):  # all of its windows have a twin
            whole[at] = True
            if not ref[3]:
                spans.extend((ref[0], ref[1], size, ref[2] - len(left), ref[2] + len(right)) for size in sizes if size <= len(left) + len(right))
            continue
        rights.append(right)
        lefts.append(left)
        shared.append(link)
        refs.append(ref)
        whole.append(bool(ref[3]))
        link = len(right)
    close()
    yield joined(spans)


def _merge(batches, sizes: tuple[int, ...]):
    """Reduce side: rows come ordered by part; each part's runs are merged and its twins looked up."""
    part, blobs = None, []

    def rows():
        for s in resolved([Run(b) for b in blobs], sizes):
            yield pa.RecordBatch.from_arrays([pa.array(s[:, c]) for c in range(5)], NAMES)

    for batch in batches:
        plain = batch.filter(pa.compute.is_null(batch.column(1)))
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays(plain.columns[2:], NAMES)
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if blob is None:
                continue
            if p != part and blobs:
                yield from rows()
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield from rows()


def repeated_spans(docs: DataFrame, *, size: int = SIZE, short: int | None = None, id_col="doc_id", text_col="text", out_col="spans", short_col="short_spans", part_bytes: int = PART_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """docs with out_col: ordered, disjoint byte ranges (start, end) covered by strings of `size` bytes that occur elsewhere too.

    short: a smaller size, whose ranges are given in short_col.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(shuffle_parts(spark), math.ceil(held / part_bytes))
    sizes = {out_col: size} if short is None else {out_col: size, short_col: short}
    *out, k1, k2 = free(docs, *sizes, "k1", "k2")
    sizes = dict(zip(out, sizes.values()))
    every = tuple(sizes.values())
    own = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)]
    keyed = docs.withColumn(k1, F.xxhash64(*own)).withColumn(k2, F.xxhash64(F.lit("second"), *own))
    runs = keyed.select(k1, k2, F.col(text_col).cast("string")).mapInArrow(lambda b: _runs(b, parts, every), f"part int, run binary, {SPANS}")
    met = runs.repartitionById(parts, "part").mapInArrow(lambda b: _merge(b, every), SPANS)
    scratch = scratch or Scratch(spark, "repeats")
    spans = scratch.keep(met, "spans").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(*[F.array_sort(F.collect_set(F.when(F.col("size") == n, F.struct("start", "end")))).alias(c) for c, n in sizes.items()])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return keyed.join(spans.hint("shuffle_hash"), [k1, k2], "left").drop(k1, k2).withColumns({c: F.coalesce(_union(c), none) for c in sizes})


def _union(spans: str):
    """Sorted ranges without overlaps."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (last["end"] >= x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, start, step)


def strip(found: DataFrame, *, text_col="text", spans_col="spans", out_col="kept") -> DataFrame:
    """repeated_spans()'s rows with out_col: the remaining bytes of each text."""

    @F.pandas_udf("binary")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, own):
            raw = text.encode() if isinstance(text, str) else b""
            at, out = 0, []
            for s in own:
                out.append(raw[at : s["start"]])
                at = s["end"]
            return b"".join([*out, raw[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    return found.withColumn(free(found, out_col)[0], kept(F.col(text_col).cast("string"), F.col(spans_col)))


def digest(found: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The contract's columns of strip()'s rows, under its default names; n_repeated: bytes in passages of the shorter size."""
    return found.select(
        id_col,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        *[F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_repeated") for c in ("short_spans",) if c in found.columns],
    )


def brute_force(texts: list[bytes], size: int = SIZE) -> list[list[tuple[int, int]]]:
    """The same spans by counting every window; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] = count.get(t[i : i + size], 0) + 1
    out = []
    for t in texts:
        own: list[tuple[int, int]] = []
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                own = [*own[:-1], (own[-1][0], i + size)] if own and i <= own[-1][1] else [*own, (i, i + size)]
        out.append(own)
    return out
