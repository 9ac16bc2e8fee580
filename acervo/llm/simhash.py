"""SimHash near-duplicates linked through anchor points of a covering code.

Anchors are the words of the product of two binary Golay codes on the lower 46
fingerprint bits.  The Golay code is perfect with covering radius 3, so each half
of a fingerprint has one home anchor within 3 bits; two fingerprints that differ
in at most `threshold` bits meet at each other's home anchors if every one of them
is replicated to the anchors within 3 + threshold bits (the errors of both halves
together at most threshold beyond the radius).  Only rows of one anchor are compared.

Copies are collapsed to one fingerprint before any replication, and a crowded
anchor answers by looking up each home fingerprint's neighbours in a sorted array, so its
cost follows its size and not the square of it; links leave an anchor as a spanning
forest, never as all pairs.

Defined results: null or empty text, or text of white space only, has fingerprint
zero and is linked like any other; a null doc_id keeps its row and never names a
component unless all its members are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.llm.common import Scratch, small_batches

SEED = 42
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Up to this many fingerprints of one anchor are compared with each other directly.
CROWD = 96


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of whole-text word shingles (a bit is set if it is in over half the hashes)."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined, n = b" ".join(w), min(shingle, len(w))
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = ends - [len(x) + 1 for x in w]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist())])
    votes = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 18):
        votes += np.unpackbits(np.frombuffer(raw[at : at + (1 << 18)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(raw) // 8).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): fp holds the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


@lru_cache
def _tables(threshold: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of the 23 single bits; by extra errors and syndrome, the error patterns of that weight beyond the radius."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GOLAY << (j - 11)
        unit[i] = x
    by: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(threshold + 1)]
    for weight in range(4 + threshold):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= int(unit[i])
            by[max(0, weight - 3)][s].append(sum(1 << i for i in bits))
    return unit, [[np.array(x, np.int64) for x in level] for level in by]


def _syndromes(half: np.ndarray, unit: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.int64)
    for i in range(23):
        out ^= np.where(half >> i & 1, unit[i], 0)
    return out


def anchors(prints: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor within reach of each fingerprint; home marks the nearest one."""
    unit, by = _tables(threshold)
    low, high = prints & 0x7FFFFF, prints >> 23 & 0x7FFFFF
    rows, found, home = [], [], []
    for i, (a, b, sa, sb) in enumerate(zip(low.tolist(), high.tolist(), _syndromes(low, unit).tolist(), _syndromes(high, unit).tolist())):
        n = 0
        for x in range(threshold + 1):
            for y in range(threshold + 1 - x):
                at = ((b ^ by[y][sb])[:, None] << 23 | (a ^ by[x][sa])[None, :]).ravel()
                found.append(at)
                home.append(np.full(len(at), x == y == 0))
                n += len(at)
        rows.append(n)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.repeat(np.arange(len(prints)), rows), np.concatenate(found), np.concatenate(home)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) with the same components as the edges (a, b) on n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


@lru_cache
def _flips(threshold: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for w in range(1, threshold + 1) for bits in combinations(range(64), w)], np.uint64)


def _crowd(prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one crowded anchor between its home fingerprints and all that reach it, as a forest."""
    prints = prints.view(np.uint64)
    own = np.flatnonzero(home)
    order = np.argsort(prints)
    ranked, left, right = prints[order], [], []
    if len(prints) <= 2 * len(_flips(threshold)):
        for part in np.array_split(own, max(1, len(own) * len(prints) // 4_000_000)):
            x, y = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[None, :]) <= threshold)
            left.append(part[x])
            right.append(y)
    else:
        for flip in _flips(threshold):
            wanted = prints[own] ^ flip
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            hit = ranked[at] == wanted
            left.append(own[hit])
            right.append(order[at[hit]])
    return _forest(len(prints), np.concatenate(left), np.concatenate(right))


def _compare(batches, threshold: int):
    """Rows (anchor, fp, home) sorted by anchor, in; links (a, b) of fingerprints, out."""

    def links(anchor, prints, home):
        edge = np.flatnonzero(np.diff(anchor)) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([start, [len(anchor)]]))
        a, b = [], []
        crowded = np.repeat(size > CROWD, size)
        for lag in range(1, min(CROWD, int(size.max()))):
            i = np.flatnonzero((anchor[lag:] == anchor[:-lag]) & ~crowded[lag:])
            if not len(i):
                break
            i = i[(home[i] | home[i + lag]) & (np.bitwise_count((prints[i] ^ prints[i + lag]).view(np.uint64)) <= threshold)]
            a.append(prints[i])
            b.append(prints[i + lag])
        for s, n in zip(start[size > CROWD], size[size > CROWD]):
            x, y = _crowd(prints[s : s + n], home[s : s + n], threshold)
            a.append(prints[s : s + n][x])
            b.append(prints[s : s + n][y])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[list[np.ndarray]] = []

    def take(keep_last: bool):
        nonlocal held
        got = [np.concatenate(v) for v in zip(*held)]
        cut = int(np.searchsorted(got[0], got[0][-1])) if keep_last else len(got[0])
        held = [[v[cut:] for v in got]] if cut < len(got[0]) else []
        return links(*(v[:cut] for v in got)) if cut else None

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
            if sum(len(v[0]) for v in held) > 200_000 and held[0][0][0] != held[-1][0][-1] and (out := take(True)) is not None:
                yield out
    if held and (out := take(False)) is not None:
        yield out


def near_links(prints: DataFrame, *, threshold: int = 2, fp_col="fp") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints; their components are those of all pairs within `threshold` bits."""

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                own = batch.column(0).slice(at, 2000).to_numpy()
                row, anchor, home = anchors(own, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row]), pa.array(home)], ["anchor", "fp", "home"])

    spread = prints.select(fp_col).mapInArrow(replicate, "anchor long, fp long, home boolean")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without a link are left out.

    Alternates large-star and small-star steps until nothing changes; each step is
    aggregations and joins, so no node's neighbours are ever gathered in one place.
    """
    edges = scratch.keep(links.select("a", "b"), "edges-0")
    last, step = None, 0
    while True:
        step += 1
        # dealt out by a node once, for its smallest neighbour and the join with it
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.filter("a > b").repartition("a").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = scratch.keep(small.filter("a > b").distinct(), f"edges-{step}")
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"edges-{step - 1}")
        if mark == last:
            break
        last = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 3, threshold: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id of the documents reachable through links."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
    roots = scratch.keep(components(near_links(nodes, threshold=threshold), scratch), "roots")
    placed = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = placed.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(of.hint("merge"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 3, threshold: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """docs without near-copies: of each component the row with the smallest id stays (null ids stay)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold, scratch=scratch)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti")


def digest(found: DataFrame, *, id_col="doc_id") -> DataFrame:
    """The contract's columns of near_duplicates()'s rows."""
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
