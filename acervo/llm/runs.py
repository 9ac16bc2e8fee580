"""Periodic runs of words, by branching tandems in an enhanced suffix array.

A run is a maximal stretch with smallest period q and length of at least max(min_length, 2 q).
Its rightmost square, two equal halves of q words, branches: the halves go on differently.  Two
suffixes that are q words apart and agree in exactly q words are such a pair, so for each LCP
interval of depth q the suffixes on the smaller side of each of its boundaries ask the inverse
suffix array whether the suffix q words before or behind them lies on the other side.  Every
pair of suffixes meets at one boundary alone, and a suffix is on the smaller side at most
log2(n) times; intervals are pairs of numbers, there is no tree.  A square found is rotated to the
left as far as words agree, in steps of halving powers of two, and squares with equal ends are one run,
whose period is the smallest.

Suffix arrays come from prefix doubling, of many short documents at once: words are numbered
by document, so that no match leaves one, and behind each document stands a number of its
own.  The ranks of every doubling stay, and with them both prefixes and suffixes are compared in
logarithmic time.

A document is the unit of work: documents spread over the scan's tasks without a shuffle, a batch
holds about BATCH_WORDS words or one longer document, and memory follows the batch (some 300
bytes a word).

Defined results: null texts have no words, no runs and an empty remainder; documents of one id
are told apart as rows; an empty table gives no rows; other columns pass through, and an added
column whose name is taken ends in an underscore.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from acervo.llm.common import free, small_batches

WORD = re.compile(r"[^ \t-\r]+")
MIN_LENGTH = 12
#: Words that share one suffix array, and pairs of suffixes that are tested at once.
BATCH_WORDS, PAIRS = 250_000, 1 << 20


def doubled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, lcp with the suffix before, ranks): ranks[k] is equal where 2**k symbols are; the last has no equals.

    No symbol may follow the last place of ids but itself, that is, the last one is unique.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(ids[sa]) != 0
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int32)
    rank[sa] = np.repeat(first, sizes)
    lcp, ranks, step = np.zeros(n, np.int32), [rank], 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # of suffixes that share their rank
    while len(slots):
        own = sa[slots]
        old = rank[own].astype(np.int64)
        key = old * (n + 1) + rank[own + step]
        order = np.argsort(key)
        own, key, old = own[order], key[order], old[order]
        sa[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = np.diff(key) != 0
        split = np.flatnonzero(new[1:] & (old[1:] == old[:-1])) + 1
        a, b = own[split - 1] + step, own[split] + step
        lcp[slots[split]] = step + common(ranks[:-1], a, b)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(slots)))
        rank = rank.copy()
        rank[own] = np.repeat(slots[first], sizes)
        ranks.append(rank)
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    return sa, lcp, ranks


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the strings from a and from b share, known to be fewer than 2**len(ranks)."""
    a, b = a.copy(), b.copy()
    at = a.copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = (ranks[k][a] == ranks[k][b]).astype(a.dtype) << k
        a += same
        b += same
    return a - at


def bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each boundary: the nearest one before with a smaller lcp, and the nearest behind with one that isn't larger."""
    before, behind, open_ = [0] * len(lcp), [len(lcp)] * len(lcp), [0]
    values = lcp.tolist()
    for k, v in enumerate(values):
        if not v:  # nothing reaches over it
            for x in open_:
                behind[x] = k
            open_ = [k]
            continue
        while values[open_[-1]] > v:
            behind[open_.pop()] = k
        top = open_[-1]
        if values[top] == v:
            behind[top] = k
            before[k] = before[top]
            open_[-1] = k
        else:
            before[k] = top
            open_.append(k)
    return np.array(before), np.array(behind)


def tandems(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of all branching squares."""
    n = len(sa)
    isa = np.full(n + 1, -1, np.int64)  # behind the end there is no suffix
    isa[sa] = np.arange(n)
    low, high = bounds(lcp)
    at = np.flatnonzero(lcp)
    low, high, depth = low[at], high[at], lcp[at].astype(np.int64)
    left = at - low <= high - at
    first, count = np.where(left, low, at), np.where(left, at - low, high - at)
    other, upto = np.where(left, at, low), np.where(left, high, at)  # the other side, end exclusive
    found, total = [], np.cumsum(count)
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS))
    for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
        if lo == hi:
            continue
        many = count[lo:hi]
        k = np.repeat(np.arange(lo, hi), many)
        suffix = sa[np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + first[k]]
        d, o, u = depth[k], other[k], upto[k]
        for back in (False, True):
            mate = suffix - d if back else suffix + d
            mate = np.where((mate < 0) | (mate > n), n, mate)
            met = isa[mate]
            hit = np.flatnonzero((met >= o) & (met < u))
            found.append(np.stack([(mate if back else suffix)[hit], d[hit]]))
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of all runs, a row each, by start and then length."""
    sa, lcp, ranks = doubled(ids)
    place, half = tandems(sa, lcp)
    at = place.copy()
    for k in range(len(ranks) - 1, -1, -1):  # rotate to the left
        from_ = at - (1 << k)
        same = (from_ >= 0) & (ranks[k][np.maximum(from_, 0)] == ranks[k][np.maximum(from_ + half, 0)])
        at = np.where(same, from_, at)
    end = place + 2 * half
    keep = end - at >= min_length
    at, end, half = at[keep], end[keep], half[keep]
    order = np.lexsort((half, end, at))
    at, end, half = at[order], end[order], half[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(end) != 0)
    return np.stack([at, end - at, half], axis=1)[new]


def numbered(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all documents, with one behind each that nothing else has; where documents start)."""
    seen: defaultdict[str, int] = defaultdict()
    seen.default_factory = seen.__len__  # a new word gets the next number
    own = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in docs]
    width, ids = len(seen) + 1, []
    for k, x in enumerate(own):
        ids += [x + k * width, [k * width + len(seen)]]
    starts = np.cumsum([0, *[len(x) + 1 for x in own]])
    return (np.concatenate(ids) if ids else np.empty(0, np.int64)), starts


def of_texts(texts: list[str | None], min_length: int = MIN_LENGTH) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs as (start, length, period) by start and period, remaining words) of each text, in order."""

    def solve(docs: list[list[str]]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
        ids, starts = numbered(docs)
        found = runs_of(ids, min_length)
        parts = np.searchsorted(found[:, 0], starts)
        for words, base, lo, hi in zip(docs, starts.tolist(), parts, parts[1:], strict=False):
            own = sorted(((s - base, n, q) for s, n, q in found[lo:hi].tolist()), key=lambda x: (x[0], x[2]))
            kept = words
            if own:
                cover = np.zeros(len(words) + 1, np.int64)
                for s, n, q in own:
                    cover[s + q] += 1
                    cover[s + n] -= 1
                kept = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
            yield len(words), own, " ".join(kept)

    held, size = [], 0
    for text in texts:
        words = WORD.findall(text or "")
        if held and size + len(words) > BATCH_WORDS:
            yield from solve(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield from solve(held)


def find_runs(docs: DataFrame, *, text_col="text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, by start and then period) and collapsed.

    collapsed is the text without what runs repeat: every word behind a run's first period goes,
    and one space joins the rest.
    """
    small_batches(docs.sparkSession)
    n_words, runs, collapsed = free(docs, "n_words", "runs", "collapsed")
    entry = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = StructType([*docs.schema.fields]).add(n_words, LongType()).add(runs, ArrayType(entry)).add(collapsed, StringType())
    kinds = to_arrow_schema(schema)
    names = docs.columns
    at = names.index(text_col)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(of_texts(batch.column(at).to_pylist(), min_length))
            added = [[x[0] for x in out], [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x[1]] for x in out], [x[2] for x in out]]
            own = [pa.array(v, kinds.field(len(names) + k).type) for k, v in enumerate(added)]
            yield pa.RecordBatch.from_arrays([c.cast(kinds.field(k).type) for k, c in enumerate(batch.columns)] + own, schema=kinds)

    return docs.mapInArrow(solve, schema)


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    """Counts, the longest run and hashes of all runs and of what remains."""
    best = F.array_sort("runs", lambda a, b: F.coalesce(*[F.nullif(F.signum(x - y).cast("int"), F.lit(0)) for x, y in ((b["length"], a["length"]), (a["start"], b["start"]), (a["period"], b["period"]))], F.lit(0)))
    named = found.withColumn("best", F.try_element_at(best, F.lit(1)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return named.select(
        F.col(id_col).alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The contract's documents: where crc32(id) % 10 = 0, words from a on repeat with period p (see op13)."""
    h, w, a, p = free(docs, "h", "w", "a", "p")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.withColumn(h, F.crc32(F.col(id_col).cast("string"))).withColumn(w, F.when(F.col(h) % 10 == 0, words))
    n, g = F.size(w).cast("long"), F.floor(F.col(h) / 10)
    bent = chosen.withColumn(a, F.when(n > 0, g % n)).withColumn(p, F.when(n > 0, 1 + F.floor((n - F.col(a)) / (3 + g % 8))))
    made = F.transform(w, lambda x, i: F.when(i < F.col(a), x).otherwise(F.element_at(w, (F.col(a) + (i - F.col(a)) % F.col(p) + 1).cast("int"))))
    return bent.withColumn(text_col, F.when(F.col(a).isNotNull(), F.array_join(made, " ")).otherwise(F.col(text_col))).drop(h, w, a, p)


def brute_force(words: list[str], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs by trying every period, for tests."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))
