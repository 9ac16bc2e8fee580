"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: each shard holds some megabytes of text, one
row per term with the sorted token positions of that term, and one row (null
term) with the shard's documents.  A search picks the benchmark windows whose words the
shard all has, starts each from its rarest term there, and intersects the offset-adjusted
lists of the next terms until the phrase is found or the list is empty.

Defined results: null or empty text has no words; a benchmark item without
words has no windows; rows with a repeated or null doc_id stay separate rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.llm.common import Scratch, small_batches

#: Words are runs of digits, a-z and everything outside ASCII (UTF-8 bytes from 0x80).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
SHARD_BYTES = 8 << 20
#: Benchmark text whose windows (about one for seven characters, 40 bytes each) are searched in one pass.
BLOCK_CHARS = 4_000_000


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.lower())


def build_index(docs: DataFrame, terms=None, *, id_col="doc_id", text_col="text", shard_bytes=SHARD_BYTES) -> DataFrame:
    """Positional postings of `docs`: (shard, term, positions, doc_ids, starts).

    terms: only these are stored (a benchmark cannot match others); None stores all.
    positions: little-endian uint32 gaps between a term's token positions; documents
    follow each other with one empty position between them.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("positions", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.BinaryType())])
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}

    def shards(batches):
        name, number = TaskContext.get().partitionId(), 0
        ids, starts, parts, at, held = [], [], [], 0, 0
        vocabulary = {} if known is None else known

        def flush():
            nonlocal ids, starts, parts, at, held, number, vocabulary
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            where = np.flatnonzero(tokens >= 0)
            order = where[np.argsort(tokens[where], kind="stable")]
            kinds, first = np.unique(tokens[order], return_index=True)
            by_id = list(vocabulary) if known is None else sorted(vocabulary)
            lists = [np.diff(x, prepend=0).astype("<u4").tobytes() for x in np.split(order, first[1:])] if len(kinds) else []
            shard = f"{name}-{number}"
            rows = {"shard": [shard] * (len(lists) + 1), "term": [None, *[by_id[k] for k in kinds]], "positions": [None, *lists], "doc_ids": [ids, *[None] * len(lists)], "starts": [np.array([*starts, at], "<u4").tobytes(), *[None] * len(lists)]}
            number += 1
            ids, starts, parts, at, held = [], [], [], 0, 0
            if known is None:
                vocabulary = {}
            return pa.RecordBatch.from_pydict(rows, schema=arrow)

        arrow = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("positions", pa.binary()), ("doc_ids", pa.list_(_arrow_type(id_type))), ("starts", pa.binary())])
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(raw)
                if known is None:
                    codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int32, len(found))
                else:
                    codes = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
                ids.append(doc)
                starts.append(at)
                parts += [codes, np.array([-1], np.int32)]
                at += len(found) + 1
                held += len(raw or b"")
                if held >= shard_bytes:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(shards, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def benchmark_windows(items: list[tuple], size: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of `size` consecutive item words (a shorter item is one window) and the items that hold them."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            found[tuple(w[i : i + size])].add("" if item is None else str(item))
    return found


class Windows:
    """The windows of some items as rows of word numbers (-1 behind a short one), and the item of each."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names, codes, owner = [], [], []
        for item, text in items:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int32)
            if not len(own):
                continue
            if len(own) < size:
                own = np.pad(own, (0, size - len(own)), constant_values=-1)
            codes.append(np.lib.stride_tricks.sliding_window_view(own, size))
            owner.append(np.full(len(codes[-1]), len(self.names), np.int32))
            self.names.append("" if item is None else str(item))
        self.codes = np.concatenate(codes) if codes else np.zeros((0, size), np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)

    def candidates(self, known: Iterable[int], missing: int = 0) -> np.ndarray:
        """Windows of which all but `missing` words are among the known ones."""
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[list(known)] = True
        there[-1] = True
        return np.flatnonzero((~there[self.codes]).sum(1) <= missing)

    def __getitem__(self, i: int) -> tuple[int, ...]:
        return tuple(c for c in self.codes[i].tolist() if c >= 0)


def _shard_lists(rows: pd.DataFrame, vocabulary: dict[bytes, int]):
    head = rows[rows["term"].isna()].iloc[0]
    lists = {vocabulary[bytes(t)]: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(rows["term"], rows["positions"]) if t is not None and bytes(t) in vocabulary}
    return list(head["doc_ids"]), np.frombuffer(head["starts"], "<u4").astype(np.int64), lists


def _members(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hay, needles)
    at[at == len(hay)] = 0
    return hay[at] == needles


def phrase_starts(window: tuple, lists: dict) -> np.ndarray:
    """Positions at which the whole window occurs."""
    order = sorted(range(len(window)), key=lambda i: len(lists[window[i]]))
    starts = lists[window[order[0]]] - order[0]
    for i in order[1:]:
        starts = starts[_members(starts + i, lists[window[i]])]
        if not len(starts):
            break
    return starts


def near_starts(window: tuple, lists: dict, slop: int, missing: int) -> np.ndarray:
    """Positions at which all but `missing` terms stand within `slop` of their place.

    One of the missing+1 rarest terms must be there, up to `slop` from its place, so only their lists are walked.
    """
    none = np.zeros(0, np.int64)
    order = sorted(range(len(window)), key=lambda i: len(lists.get(window[i], none)))
    starts = np.unique(np.concatenate([lists.get(window[i], none) - i + k for i in order[: missing + 1] for k in range(-slop, slop + 1)]))
    lost = np.zeros(len(starts), np.int64)
    for n, i in enumerate(order):
        hay = lists.get(window[i], none)
        if len(hay) and len(starts):
            at = np.searchsorted(hay, starts + i - slop)
            near = (at < len(hay)) & (hay[np.minimum(at, len(hay) - 1)] <= starts + i + slop)
            lost += ~near
        else:
            lost += 1
        keep = lost <= missing
        starts, lost = starts[keep], lost[keep]
    return starts


def fits(window: tuple, lists: dict, start: int, slop: int, missing: int, low: int, high: int) -> bool:
    """Whether all but `missing` words of a window that begins at start stand within `slop` of their place and inside [low, high)."""
    lost = 0
    for i, w in enumerate(window):
        hay = lists.get(w)
        a, b = max(start + i - slop, low), min(start + i + slop, high - 1)
        lost += hay is None or np.searchsorted(hay, a) >= np.searchsorted(hay, b, "right")
    return lost <= missing


def _search(index: DataFrame, windows: Windows, slop: int | None, missing: int) -> DataFrame:
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("doc_no", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))])
    held = index.sparkSession.sparkContext.broadcast(windows)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        windows = held.value
        ids, bounds, lists = _shard_lists(rows, windows.vocabulary)
        marks = np.zeros(bounds[-1] + 1, np.int32)
        exact, near = defaultdict(set), defaultdict(set)
        for i in windows.candidates(lists):
            starts = phrase_starts(windows[i], lists)
            if len(starts):
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + len(windows[i]), -1)
                for d in np.unique(np.searchsorted(bounds, starts, "right") - 1):
                    exact[d].add(windows.names[windows.owner[i]])
        for i in windows.candidates(lists, missing) if slop is not None else ():
            for at in near_starts(windows[i], lists, slop, missing):
                # the document of the words that are there
                for d in {int(np.searchsorted(bounds, p, "right") - 1) for c, place in zip(windows[i], range(at, at + WINDOW)) if c in lists for p in lists[c][np.searchsorted(lists[c], place - slop) : np.searchsorted(lists[c], place + slop, "right")]}:
                    if fits(windows[i], lists, at, slop, missing, int(bounds[d]), int(bounds[d + 1])):
                        near[d].add(windows.names[windows.owner[i]])
        covered = np.cumsum(marks) > 0
        edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
        spans = defaultdict(list)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            d = int(np.searchsorted(bounds, a, "right") - 1)
            spans[d].append([int(a - bounds[d]), int(b - bounds[d])])
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "doc_no": range(len(ids)), "doc_id": pd.Series(ids, dtype=object), "n_words": np.diff(bounds) - 1, "hits": [spans.get(d, []) for d in range(len(ids))], "items": [sorted(exact.get(d, ())) for d in range(len(ids))], "near_items": [sorted(near.get(d, ())) for d in range(len(ids))]})

    return index.groupBy("shard").applyInPandas(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", slop: int | None = None, missing: int = 2, block_chars: int = BLOCK_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word spans inside benchmark windows), items, near_items.

    slop: also report items of which all but `missing` words of a window stand within
    `slop` words of their place (near_items; exact matches included).
    The benchmark is the query set: it is searched in blocks of at most about block_chars
    characters, each against all rows, so no block outgrows a broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "decontam")
    items = benchmark.select(F.col(item_col), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")))
    chars = items.agg(F.sum(F.length(items.columns[1]))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    part = F.pmod(F.xxhash64(*items.columns), F.lit(blocks))
    found = index = None
    for b in range(blocks):
        windows = Windows(items.filter(part == b).collect())
        if index is None:
            terms = set(windows.vocabulary) if blocks == 1 else None
            index = scratch.keep(build_index(docs, terms, id_col=id_col, text_col=text_col), "index")
        hit = _search(index, windows, slop, missing)
        found = hit if found is None else found.unionByName(hit)
    if blocks > 1:
        together = found.groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
        found = together.withColumn("hits", _union(F.array_sort("hits")))
    return found.select("doc_id", "n_words", "hits", "items", "near_items")


def _union(spans):
    """Sorted spans without overlaps."""
    start = F.array().cast("array<array<bigint>>")
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= x[0]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(F.element_at(acc, -1), 2), x[1]))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, start, step)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of decontaminate()'s rows."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], benchmark: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The same digest by looking at every document word; for tests."""
    out, windows = [], benchmark_windows(benchmark, size)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= got
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(docs: list[tuple], benchmark: list[tuple], slop: int, missing: int, size: int = WINDOW) -> list[set[str]]:
    """The items near each document, by trying every start; for tests."""
    out, windows = [], benchmark_windows(benchmark, size)
    for _, text in docs:
        w, found = words(text), set()
        for window, items in windows.items():
            for start in range(-slop - len(window), len(w) + slop + len(window)):
                lost = sum(not any(0 <= p < len(w) and w[p] == x for p in range(start + i - slop, start + i + slop + 1)) for i, x in enumerate(window))
                if lost <= missing:
                    found |= items
                    break
        out.append(found)
    return out
