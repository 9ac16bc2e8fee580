"""Many terms in many texts: the longest term that each text holds (SIG-10, JOI-6).

Terms pass from the longest to the shortest, in blocks of bounded size.  A text leaves with its
first find, so that its letters meet only the lengths above that, however many terms there are.  Lengths
within a factor of about 1.4 make a class: one rolling hash of the class's least length is looked up at
every letter of a text, and only where a term of the class begins so are the single lengths tried.
Equal hashes are compared letter by letter, so nothing rests on them.  A block is broadcast (its
letters are bounded) and gone from the driver and the executors before the next is built.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.sources.tables import shared_dir

#: Letters of the terms of one block; they pass through the driver.
BLOCK_LETTERS = 8 << 20
#: Terms of up to so many letters must stand as words.
SHORT = 4
#: Letters of texts that are looked through together.
GROUP = 1 << 17
BASE = 0x9E3779B97F4A7C15


def powers(block: dict, base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64; kept beside a block."""
    if len(block.get(base, ())) < n:
        steps = np.full(max(n, 2 * GROUP), base, np.uint64)
        steps[0] = 1
        block[base] = np.cumprod(steps, dtype=np.uint64)
    return block[base][:n] if n else np.zeros(0, np.uint64)


def letters(text: bytes) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Numbers that stand for letters in a hash."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def anchor(n: int) -> int:
    """The least length of the class of n."""
    k = 2 * (n.bit_length() - 1)
    return max(int(2 ** (j / 2)) for j in (k, k + 1) if int(2 ** (j / 2)) <= n)


def packed(terms: pa.Array, ids: np.ndarray) -> dict:
    """A block's terms by classes and lengths, longest first: sorted hashes with the terms' letters and ids."""
    size = pc.utf8_length(terms).to_numpy()
    order = np.argsort(-size, kind="stable")
    terms, ids, size = terms.take(pa.array(order)), ids[order], size[order]
    edges = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1], [True]]))
    raw = terms.cast(pa.large_binary())
    at, data = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset :], raw.buffers()[2]
    classes: list[dict] = []
    for s, e in zip(edges[:-1], edges[1:]):
        n, m = int(size[s]), int(e - s)
        codes = letters(data.slice(at[s], at[e] - at[s]).to_pybytes()).reshape(m, n)
        q, h, first = anchor(n), np.zeros(m, np.uint64), None
        step = powers({}, BASE, n)
        for j in range(n):
            h += mixed(codes[:, j]) * step[j]
            if j == q - 1:
                first = np.unique(h)
        by = np.argsort(h)
        found = {"n": n, "hash": h[by], "id": ids[s:e][by], "codes": codes[by].astype(np.uint16 if codes.max() < 1 << 16 else np.uint32)}
        if not classes or classes[-1]["q"] != q:
            classes.append({"q": q, "first": [], "lengths": []})
        classes[-1]["first"].append(first)
        classes[-1]["lengths"].append(found)
    return {"classes": [{**c, "first": np.unique(np.concatenate(c["first"]))} for c in classes]}


def _table(kind: dict) -> tuple[np.ndarray, np.uint64]:
    """Which leading bits the hashes of a class's beginnings have, and how far to shift for them; made once a process."""
    if "table" not in kind:
        bits = min(max(16, (16 * len(kind["first"])).bit_length()), 26)
        shift = np.uint64(64 - bits)
        made = np.zeros(1 << bits, bool)
        made[kind["first"] >> shift] = True
        kind["table"] = made, shift
    return kind["table"]


def _words(codes: np.ndarray) -> np.ndarray:
    """Which letters belong to words."""
    each, at = np.unique(codes, return_inverse=True)
    return np.array([(c := chr(x)).isalnum() or c == "_" for x in each.tolist()], bool)[at]


def _standing(word: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether places have a word boundary at both ends, in texts from low to high."""
    before = (start > low) & word[np.maximum(start - 1, 0)]
    after = (end < high) & word[np.minimum(end, len(word) - 1)]
    return (before != word[start]) & (after != word[end - 1])


class Texts:
    """Texts one behind the other, with the sums that give the hash of any stretch."""

    def __init__(self, codes: list[np.ndarray], number: np.ndarray, block: dict):
        self.parts, self.number, self.block = codes, number, block
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.end = np.cumsum([len(x) for x in codes], dtype=np.int64)
        self.start = self.end - np.array([len(x) for x in codes], np.int64)
        n = len(self.codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.codes) * powers(block, BASE, n), out=self.sums[1:])
        self.back = powers(block, pow(BASE, -1, 1 << 64), n)
        self.word: np.ndarray | None = None

    def only(self, keep: np.ndarray) -> Texts:
        return Texts([x for x, k in zip(self.parts, keep) if k], self.number[keep], self.block)

    def beginnings(self, kind: dict) -> np.ndarray:
        """Places where a term of a class may begin."""
        q = kind["q"]
        if len(self.codes) < q:
            return np.zeros(0, np.int64)
        table, shift = _table(kind)
        h = self.sums[q:] - self.sums[:-q]
        h *= self.back[: len(h)]
        h >>= shift
        return np.flatnonzero(table[h])

    def finds(self, at: np.ndarray, own: np.ndarray, length: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, id) of terms of one length that stand at places of texts."""
        n, hashes = length["n"], length["hash"]
        fits = at + n <= self.end[own]
        at, own = at[fits], own[fits]
        h = (self.sums[at + n] - self.sums[at]) * self.back[at]
        row = np.searchsorted(hashes, h)
        while len(at):
            live = (row < len(hashes)) & (hashes[np.minimum(row, len(hashes) - 1)] == h)
            at, own, h, row = at[live], own[live], h[live], row[live]
            if not len(at):
                return
            same = np.fromiter((bool((self.codes[p : p + n] == length["codes"][r]).all()) for p, r in zip(at, row)), bool, len(at))
            if n <= SHORT:
                self.word = _words(self.codes) if self.word is None else self.word
                same &= _standing(self.word, at, at + n, self.start[own], self.end[own])
            yield own[same], length["id"][row[same]]
            row = row + 1  # another term of the same hash


def look(codes: list[np.ndarray], size: np.ndarray, best: np.ndarray, block: dict) -> None:
    """Puts into size and best the longest term of a block in each text, of equal ones that with the largest id; what was found before stays if it is longer."""
    held = Texts(codes, np.arange(len(codes)), block)
    for kind in block["classes"]:
        wanted = size[held.number] <= kind["lengths"][0]["n"]
        if (held.end - held.start)[wanted].sum() < 0.7 * len(held.codes):
            held = held.only(wanted)
        at = held.beginnings(kind)
        own = np.searchsorted(held.end, at, "right")
        for length in kind["lengths"]:
            n = length["n"]
            open_ = size[held.number[own]] <= n
            at, own = at[open_], own[open_]
            for text, id in held.finds(at, own, length):
                number = held.number[text]
                fresh = size[number] < n
                size[number[fresh]], best[number[fresh]] = n, np.iinfo(np.int64).min
                np.maximum.at(best, number, id)


def _blocks(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(length, first block, blocks) of lengths and the numbers of their terms, longest first; a block has whole lengths or a part of one."""
    out, now, held = [], -1, BLOCK_LETTERS
    for n, terms in sizes:
        parts = min(terms, -(-n * terms // BLOCK_LETTERS))
        if parts > 1 or held + n * terms > BLOCK_LETTERS:
            now, held = now + 1, 0
        out.append((n, now, parts))
        now, held = now + parts - 1, held + n * terms if parts == 1 else BLOCK_LETTERS
    return out


def longest_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(md5, size, id): of each text (md5, low) the longest term (t, id) it contains, the largest id among equals.

    Nulls and empty terms match nothing; texts without a term give no row; rows of one md5 are one text.
    """
    spark = texts.sparkSession
    root = f"{shared_dir(spark)}/acervo-terms-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    own = keep(terms.filter("t != ''").groupBy("t").agg(F.max("id").cast("long").alias("id")).withColumn("n", F.length("t")), "own")
    blocks = _blocks([(r.n, r.terms) for r in own.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n")).collect()])
    if not blocks:
        return spark.createDataFrame([], "md5 string, size long, id long")
    last = blocks[-1][1] + blocks[-1][2]
    most = [max(n for n, first, parts in blocks if first <= k < first + parts) for k in range(last)]
    placed = own.join(F.broadcast(spark.createDataFrame(blocks, "n int, first int, parts int")), "n").withColumn("block", F.col("first") + F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    own = keep(placed.select("t", "id", "block").repartition(last, "block"), "blocks", "block")

    def pass_over(left: DataFrame, number: int) -> DataFrame:
        rows = own.filter(F.col("block") == number).select("t", "id").toArrow().combine_chunks()
        if not rows.num_rows:
            return left
        sent = spark.sparkContext.broadcast(packed(rows.column("t").combine_chunks(), rows.column("id").to_numpy()))
        del rows
        after = most[number + 1] if number + 1 < last else 0

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, best = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (1, 2))
                lows = batch.column(3).cast(pa.binary())
                start = 0
                while start < len(size):
                    group, held = [], 0
                    while start + len(group) < len(size) and held < GROUP:
                        group.append(letters(lows[start + len(group)].as_py() or b""))
                        held += len(group[-1])
                    part = slice(start, start + len(group))
                    look(group, size[part], best[part], sent.value)
                    start += len(group)
                stays = size <= after if after else np.zeros(len(size), bool)
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(best), pc.if_else(pa.array(stays), batch.column(3), pa.scalar(None, batch.column(3).type))], ["md5", "size", "id", "low"])
                yield out.filter(pa.array(stays | (size > 0)))

        done = keep(left.mapInArrow(scan, "md5 string, size long, id long, low string"), f"pass-{number}")
        sent.destroy(blocking=True)
        return done

    found, left = [], texts.filter("low != ''").select("md5", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("id"), "low")
    for k in range(last):
        made = pass_over(left, k)
        left = made.filter("low is not null")
        found.append(made.filter("low is null"))
    hits = reduce(lambda a, b: a.unionByName(b), [x.select("md5", "size", "id") for x in (*found, left.filter("size > 0"))])
    return hits.groupBy("md5").agg(F.max(F.struct("size", "id")).alias("b")).select("md5", "b.size", "b.id")
