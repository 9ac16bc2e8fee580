"""Near-duplicate detection by exact set similarity (DUP-1..8, JOI-5, SET-3).

Candidates come from a positional index of the rarest shingles of each text, which loses
no pair at the threshold.  They are never written: each shingle's entries are joined to components, and the
texts of a component, a family of near-copies, meet in one task, or in the cells of a square of tasks
if they are many, where all of them are compared by their whole shingle sets.
Equal texts are collapsed to one class first, so copies never meet pair by pair.  The greedy
choice of canonical documents runs in rounds over the edges that are still undecided.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import text as X
from acervo.sources.tables import shared_dir

JACCARD, RATIO, LEAST = 0.60, 0.65, 20
#: Letters that the character ratio reads.
HEAD = 2000
#: Shingles of all classes that one task sorts: they stay within its memory.
GRAMS = 2_000_000
#: Words of 64 bits of the bitmap that tells which classes have a family.
WORDS = 1 << 16
#: Entries of a shingle, or classes of a family of near-copies, that meet in one task.
BLOCK = 4000
#: Up to so many entries of a shingle are compared with each other at once.
FEW = 16
#: Up to so many are compared with each other in one matrix.
MATRIX = 1000
#: Shingles that a family's classes are compared by at a time.
SLICE = 2048
#: Classes of a cell that are compared with the others of it at a time.
STEP = 256
#: Slack of comparisons that rounding must not decide.
EPS = 1e-9
LOG = logging.getLogger(__name__)


def _keep(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/acervo-dup-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def comparison_text(transcript: str = "texto_transcrito", ocr: str = "texto_tesseract", name: str = "nome_arquivo") -> Column:
    """DUP-1."""
    return F.coalesce(X.nonblank(transcript), X.nonblank(ocr), F.col(name))


def shingles(norm: Column | str, k: int = 3) -> Column:
    """DUP-2: distinct word k-grams; the words themselves where there are fewer."""
    w = F.filter(F.split(X.col(norm), " "), lambda x: x != "")
    grams = lambda w: F.transform(F.slice(w, 1, F.size(w) - k + 1), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]))
    return X.let(w, lambda w: F.array_distinct(F.when(F.size(w) < k, w).otherwise(grams(w))))


def char_ratio(a: Column, b: Column, size: int = HEAD) -> Column:
    """DUP-4: twice the shared multiset of characters of the first `size` letters, over both lengths."""
    x, y = F.substring(a, 1, size), F.substring(b, 1, size)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(x, c), count(y, c))))
    return F.when(F.length(x) + F.length(y) > 0, 2.0 * shared / (F.length(x) + F.length(y))).otherwise(1.0)


def classes(docs: DataFrame, text_col: str = "texto") -> DataFrame:
    """One row per distinct compared text (and cpf): rep, the smallest md5, key, a digest of both, its words, its shingles' hashes and their number, and the letters that char_ratio reads."""
    norm = docs.select("md5", X.normalize_for_compare(text_col).alias("norm"), _cpf(docs))
    rows = norm.filter(F.length("norm") >= LEAST).groupBy("norm", "cpf").agg(F.min("md5").alias("rep"))
    made = rows.select("rep", "cpf", _key("norm", "cpf").alias("key"), F.size(F.split("norm", " ")).alias("words"), F.array_distinct(F.transform(shingles("norm"), lambda g: F.xxhash64(g))).alias("grams"), F.substring("norm", 1, HEAD).alias("head"))
    return made.withColumn("n", F.size("grams"))


def _key(norm: str, cpf: str) -> Column:
    return F.md5(F.concat_ws("\n", cpf, norm))


def _cpf(docs: DataFrame) -> Column:
    return F.coalesce("cpf", F.lit("")).alias("cpf") if "cpf" in docs.columns else F.lit("").alias("cpf")


def prefix_index(kinds: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(g, rep, pos, n, band): the rarest grams of every class that a partner at `threshold` must share one of.

    Grams are ordered by the number of classes that hold them, so pos, a gram's place in its
    set, bounds what two sets still can share behind it.  Grams of one class alone come first; only their
    number counts, so none of them travels back to its class.  A band holds sizes within a factor of
    1 / threshold: partners are of the same or of neighbouring bands.
    """
    parts = max(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(kinds.agg(F.sum("n")).first()[0] or 0) // GRAMS))
    held = kinds.select("rep", F.explode("grams").alias("g")).repartition(parts, "g").withColumn("df", F.count("*").over(Window.partitionBy("g")))
    ranked = held.filter("df > 1").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s")).join(kinds.select("rep", "n").hint("merge"), "rep")
    alone = F.col("n") - F.size("s")
    most = F.col("n") - F.ceil(threshold * F.col("n") - F.lit(EPS)) + 1
    band = F.floor(F.log("n") / -math.log(threshold) + F.lit(EPS)) if threshold < 1 else F.col("n").cast("bigint")
    placed = ranked.select("rep", "n", band.alias("band"), alone.alias("alone"), F.posexplode(F.slice("s", 1, F.greatest(most - alone, F.lit(0)).cast("int"))).alias("at", "x"))
    return placed.select(F.col("x.g").alias("g"), "rep", (F.col("alone") + F.col("at")).alias("pos"), "n", "band")


def candidates(index: DataFrame, threshold: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """For tests, the pairs whose components families() makes: pairs (a, b), a < b, that share a gram of the index at places and sizes which leave `threshold` possible.

    The smaller set meets partners of its band and of the next.  Entries of a gram and band are
    counted; over `block` of them are dealt out on a square of tasks, each of about block by block.
    """
    small = index.select("g", "band", F.lit(True).alias("is_small"), "rep", "pos", "n")
    steps = F.array(F.col("band"), F.col("band") - 1) if threshold < 1 else F.array("band")
    large = index.select("g", F.explode(steps).alias("band"), F.lit(False).alias("is_small"), "rep", "pos", "n")
    both = small.unionByName(large)
    crowded = both.groupBy("g", "band").agg(F.count("*").alias("c")).filter(F.col("c") > block).select("g", "band", F.ceil(F.col("c") / block).cast("int").alias("k"))
    dealt = both.join(crowded.hint("merge"), ["g", "band"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    row, column = F.when(F.col("is_small"), F.col("own")).otherwise(F.col("other")), F.when(F.col("is_small"), F.col("other")).otherwise(F.col("own"))
    cells = each.select("g", "band", row.alias("row"), column.alias("column"), "is_small", "rep", "pos", "n")
    x = cells.filter("is_small").select("g", "band", "row", "column", F.col("rep").alias("x"), F.col("pos").alias("px"), F.col("n").alias("nx"))
    y = cells.filter("not is_small").select("g", "band", "row", "column", F.col("rep").alias("y"), F.col("pos").alias("py"), F.col("n").alias("ny"))
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    sized = F.col("nx") >= threshold * F.col("ny") - F.lit(EPS)
    needed = threshold / (1 + threshold) * (F.col("nx") + F.col("ny"))
    reach = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))  # this gram and all behind it
    pairs = x.join(y.hint("merge"), ["g", "band", "row", "column"]).filter(ordered & sized & (reach >= needed - F.lit(EPS)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns, one table for each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        if batch.num_rows:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            if held and any(held[-1].column(k)[-1].as_py() != cols[k][0].item() for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            for end in edges.tolist():
                yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
                held, start = [], end
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches: Iterator[pa.RecordBatch], keys: int, size: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first `keys` columns, in parts that cut no group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in held) > size:
                got = [np.concatenate(x) for x in zip(*held)]
                last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in got[:keys]]))
                cut = int(last[-1]) + 1 if len(last) else 0
                held = [[x[cut:] for x in got]]
                if cut:
                    yield [x[:cut] for x in got]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _near(pos_x: np.ndarray, x: np.ndarray, pos_y: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two entries' places and sizes leave `threshold` possible: what is shared is this gram and grams behind it."""
    return (np.minimum(x, y) >= threshold * np.maximum(x, y) - EPS) & (np.minimum(x - pos_x, y - pos_y) >= threshold / (1 + threshold) * (x + y) - EPS)


def _forest(kind: np.ndarray, pos: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest whose trees are the components of a gram's entries, where two are joined whose places and sizes leave `threshold` possible."""
    order = np.argsort(kind)
    kind, pos, n = kind[order], pos[order], n[order]
    left, roots, leaves = np.arange(len(kind)), [], []
    if len(kind) <= MATRIX:
        near = _near(pos[:, None], n[:, None], pos, n, threshold)
        np.fill_diagonal(near, False)
        left = np.flatnonzero(near.any(1))
        while len(left):
            root, own, front = left[0], np.zeros(len(kind), bool), near[left[0]]
            while front.any():
                own |= front
                front = near[front].any(0) & ~own
            own[root] = False
            roots.append(np.full(int(own.sum()), kind[root]))
            leaves.append(kind[own])
            left = left[~own[left]][1:]
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _near(pos[left], n[left], pos[at], n[at], threshold)
            got = left[near]
            roots.append(np.full(len(got), kind[root]))
            leaves.append(kind[got])
            front.extend(got.tolist())
            left = left[~near]
    none = np.zeros(0, kind.dtype)
    return np.concatenate([none, *roots]), np.concatenate([none, *leaves])


def _squared(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows with i, j and own: those of a key with more than `block` of them are dealt over a square, so that any two meet in a cell (i, j), i <= j."""
    crowded = rows.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") > block).select(key, F.ceil(F.col("c") / block).cast("int").alias("k"))
    dealt = rows.join(crowded.hint("merge"), key, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "k")


def families(index: DataFrame, threshold: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """(rep, root): classes of the index and the smallest of the component they are in, by the pairs that candidates() would give.

    No pair is made: of each gram's entries only a forest leaves.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for g, i, j, kind, pos, n in _whole(batches, 3):
            edges = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            start, size = edges[:-1], np.diff(edges)
            few, group = np.repeat(size <= FEW, size), np.repeat(start, size)
            for lag in range(1, FEW):
                x = np.flatnonzero(few[lag:] & (group[lag:] == group[:-lag]))
                x = x[_near(pos[x], n[x], pos[x + lag], n[x + lag], threshold)]
                seen.append(np.sort(np.stack([kind[x], kind[x + lag]], axis=1), axis=1))
            for low, m in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
                part = slice(low, low + m)
                seen.append(np.stack(_forest(kind[part], pos[part], n[part], threshold), axis=1))
            seen = [np.unique(np.concatenate(seen), axis=0)]
            if len(seen[0]) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen[0][:, 0]), pa.array(seen[0][:, 1])], ["a", "b"])
                seen = []
        for last in seen:
            yield pa.RecordBatch.from_arrays([pa.array(last[:, 0]), pa.array(last[:, 1])], ["a", "b"])

    cells = _squared(index.select("g", "rep", "pos", "n"), "g", block).select("g", "i", "j", "rep", F.col("pos").cast("long"), F.col("n").cast("long"))
    met = cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(join, "a long, b long")
    return components(met)


def components(edges: DataFrame) -> DataFrame:
    """(rep, root) of the nodes of edges (a, b): all nodes move to the smallest neighbour they know, larger and smaller ones by turns, until every one knows the smallest of its component."""
    told = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges, before, rounds = _keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"), None, 0
    while (now := told(edges)) != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = far.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        near = least.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges, before, rounds = _keep(near, f"links-{rounds}"), now, rounds + 1
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("rep"), F.col("b").alias("root")).distinct())


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many elements each of some sets shares with each of others."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    each, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at, minlength=len(each)) > 1
    owner, place = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[often[at]], (np.cumsum(often) - 1)[at][often[at]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(often.sum()), SLICE):
        part = slice(*np.searchsorted(place, [low, low + SLICE]))
        has = np.zeros((len(sets), min(SLICE, int(often.sum()) - low)), np.float32)
        has[owner[part], place[part] - low] = 1
        out += has[rows] @ has[columns].T
    return out


def _counts(heads: list[str]) -> np.ndarray:
    """How often each letter stands in each of some texts of HEAD letters at most."""
    codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in heads]
    each, at = np.unique(np.concatenate(codes), return_inverse=True)
    return np.stack([np.bincount(x, minlength=len(each)).astype(np.uint16) for x in np.split(at, np.cumsum([len(x) for x in codes])[:-1])])


def _alike(count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """char_ratio of pairs of texts."""
    size, step = count.sum(1, dtype=np.int64), max(1, (1 << 20) // count.shape[1])
    both = [np.minimum(count[a[i : i + step]], count[b[i : i + step]]).sum(1, dtype=np.int64) for i in range(0, len(a), step)]
    return 2.0 * np.concatenate(both) / (size[a] + size[b])


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, own, name, cpf, words, grams, head) sorted by their cell (root, i, j), in; similar pairs out."""
    for cell in _groups(batches, 3):
        cell = cell.combine_chunks()
        i, j = cell.column(1)[0].as_py(), cell.column(2)[0].as_py()
        own, words = cell.column(3).to_numpy(), cell.column(6).to_numpy()
        rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(rows) or not len(columns):
            continue
        names, lists = cell.column(4).combine_chunks(), cell.column(7).combine_chunks()
        order, cpf = np.argsort(np.argsort(np.array(names.to_pylist(), object))), np.unique(np.array(cell.column(5).to_pylist(), object), return_inverse=True)
        cpf = cpf[1] + (cpf[0][0] != "")  # no number is 0
        n = lists.value_lengths().to_numpy().astype(np.int64)
        inter, count = _shared(np.split(lists.flatten().to_numpy(), np.cumsum(n)[:-1]), rows, columns), None
        for low in range(0, len(rows), STEP):
            own_rows, both = rows[low : low + STEP], inter[low : low + STEP].astype(np.float64)
            good = both / (n[own_rows][:, None] + n[columns][None, :] - both) >= threshold
            if i == j:  # every two once
                good &= columns[None, :] > own_rows[:, None]
            x, y = np.nonzero(good)
            both, x, y = both[x, y], own_rows[x], columns[y]
            fits = (np.minimum(words[x], words[y]) / np.maximum(words[x], words[y]) >= RATIO) & ((cpf[x] == cpf[y]) | (cpf[x] == 0) | (cpf[y] == 0))
            both, x, y = both[fits], x[fits], y[fits]
            if len(x):
                x, y = np.where(order[x] > order[y], y, x), np.where(order[x] > order[y], x, y)
                made = {"a": names.take(pa.array(x)), "b": names.take(pa.array(y)), "jaccard": pa.array(both / (n[x] + n[y] - both))}
                if cell.num_columns > 8:
                    count = _counts(cell.column(8).to_pylist()) if count is None else count
                    made["letters"] = pa.array(_alike(count, x, y))
                yield pa.RecordBatch.from_pydict(made)


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose rep is among the nodes', and few others: a bitmap of fixed size rules the rest out before they travel."""
    places = nodes.select(F.pmod(F.xxhash64("rep"), F.lit(64 * WORDS)).alias("x")).selectExpr("x div 64 as w", "shiftleft(1L, cast(x % 64 as int)) as v")
    words = places.unionByName(nodes.sparkSession.range(WORDS).selectExpr("id as w", "0L as v")).groupBy("w").agg(F.expr("bit_or(v)").alias("v"))
    bits = words.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("s")).select(F.col("s.v").alias("bits"))
    x = F.pmod(F.xxhash64("rep"), F.lit(64 * WORDS))
    there = F.get("bits", F.floor(x / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))) != 0
    return rows.join(F.broadcast(bits), there, "left_semi")


def numbered(kinds: DataFrame) -> DataFrame:
    """kinds, written once, with a number (id) for each: shorter than a digest where grams travel."""
    return kinds if "id" in kinds.columns else _keep(kinds.withColumn("id", F.monotonically_increasing_id()), "classes")


def similar_pairs(kinds: DataFrame, threshold: float = JACCARD, block: int = BLOCK, letters: bool = True) -> DataFrame:
    """DUP-3, JOI-5, SET-3: (a, b, jaccard, letters): pairs, a < b, of classes at `threshold` Jaccard or more, with the word-count and cpf tests; letters: their char_ratio.

    The pairs grow with the square of a family of near-copies, so what travels is its classes, once for each row and column of
    the square they are dealt over, and never a pair.
    """
    own = numbered(kinds)
    index = _keep(prefix_index(own.drop("rep").withColumnRenamed("id", "rep").select("rep", "n", "grams"), threshold), "prefix")
    of = _keep(_squared(families(index, threshold, block), "root", block), "cells")
    sent = own.select(F.col("rep").alias("name"), F.col("id").alias("rep"), "cpf", F.col("words").cast("long"), "grams", *(["head"] if letters else []))
    cells = of.join(_among(sent, of).hint("merge"), "rep").select("root", "i", "j", "own", "name", "cpf", "words", "grams", *(["head"] if letters else []))
    met = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return met.mapInArrow(lambda b: _compared(b, threshold), "a string, b string, jaccard double" + ", letters double" * letters)


def refine(pairs: DataFrame, threshold: float = 0.88) -> DataFrame:
    """DUP-4, DUP-5: half Jaccard and half character ratio, and the kind of pair."""
    s = F.round(0.5 * F.col("jaccard") + 0.5 * F.col("letters"), 4)
    return pairs.select("a", "b", s.alias("similaridade")).filter(F.col("similaridade") >= threshold).withColumns({"similaridade_pct": F.round(F.col("similaridade") * 100, 1), "tipo": F.when(F.col("similaridade") >= 0.99, "Exata").otherwise("Quase-Duplicata")})


def canonical(edges: DataFrame) -> DataFrame:
    """DUP-6: (canonico, duplicata): in md5 order, whatever is no duplicate yet is canonical and takes its later neighbours.

    A round carries the edges between undecided nodes alone.  Nodes without a smaller undecided
    neighbour lead, their neighbours are duplicates, and every edge that touches one goes.  What
    loses its last edge so is canonical.  Digests are random places in the order, so the rounds
    grow as the logarithm of the nodes, long chains included.  At the end each duplicate
    goes to its smallest canonical neighbour.
    """
    edges = _keep(edges.select("a", "b").distinct(), "edges")
    left, taken, rounds = edges, [], 0
    while not left.isEmpty():
        leads = left.select(F.col("a").alias("node")).join(left.select(F.col("b").alias("node")).hint("merge"), "node", "left_anti").distinct()
        dups = _keep(left.join(leads.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), f"taken-{rounds}")
        a, b = (dups.withColumnRenamed("node", c).hint("merge") for c in "ab")
        left = _keep(left.join(a, "a", "left_anti").join(b, "b", "left_anti"), f"left-{rounds}")
        taken.append(dups)
        rounds += 1
    LOG.info("greedy choice ended after %d rounds", rounds)
    if not taken:
        return edges.select(F.col("a").alias("canonico"), F.col("b").alias("duplicata"))
    gone = reduce(DataFrame.union, taken).withColumnRenamed("node", "a")
    return edges.join(gone.hint("merge"), "a", "left_anti").groupBy(F.col("b").alias("duplicata")).agg(F.min("a").alias("canonico")).select("canonico", "duplicata")


def near_duplicates(docs: DataFrame, text_col: str = "texto", threshold: float = 0.88) -> DataFrame:
    """DUP-1..6: (canonico_md5, duplicata_md5, similaridade, similaridade_pct, tipo) of every duplicate."""
    kinds = numbered(classes(docs, text_col))
    edges = _keep(refine(similar_pairs(kinds), threshold), "pairs")
    chosen = canonical(edges)
    near = chosen.join(edges.withColumnsRenamed({"a": "canonico", "b": "duplicata"}).hint("merge"), ["canonico", "duplicata"])
    norm = docs.select("md5", X.normalize_for_compare(text_col).alias("norm"), _cpf(docs)).filter(F.length("norm") >= LEAST)
    member = norm.select("md5", _key("norm", "cpf").alias("key")).join(kinds.select("key", "rep").hint("merge"), "key").select("md5", "rep")
    of = member.join(near.withColumnRenamed("duplicata", "rep").hint("merge"), "rep", "left")
    exact = F.when(F.col("canonico").isNull(), 1.0)
    return of.select(F.coalesce("canonico", "rep").alias("canonico_md5"), F.col("md5").alias("duplicata_md5"), F.coalesce("similaridade", exact).alias("similaridade"), F.coalesce("similaridade_pct", exact * 100).alias("similaridade_pct"), F.coalesce("tipo", F.lit("Exata")).alias("tipo")).filter("canonico_md5 != duplicata_md5")


def compare(a: Column, b: Column) -> Column:
    """DUP-7: similarity of two texts: 1 for equal, 0 for an empty one; refined from 0.70 Jaccard on."""
    # what is asked more than once is bound: inside conditions it would be computed anew each time
    def jaccard(x: Column, y: Column) -> Column:
        inter = lambda g: F.size(F.array_intersect(g["s"], g["t"]))
        return X.let(F.struct(shingles(x).alias("s"), shingles(y).alias("t")), lambda g: X.let(inter(g), lambda n: n / (F.size(g["s"]) + F.size(g["t"]) - n)))

    def rated(x: Column, y: Column) -> Column:
        return X.let(jaccard(x, y), lambda j: F.when(j >= 0.70, F.round(0.5 * j + 0.5 * char_ratio(x, y), 4)).otherwise(F.round(j, 4)))

    both = F.struct(X.normalize_for_compare(a).alias("x"), X.normalize_for_compare(b).alias("y"))
    return X.let(both, lambda p: F.when(X.blank(p["x"]) | X.blank(p["y"]), 0.0).when(p["x"] == p["y"], 1.0).otherwise(rated(p["x"], p["y"])))


def exact_groups(docs: DataFrame, key: Column) -> DataFrame:
    """DUP-8: contents that occur more than once."""
    return docs.groupBy(key.alias("chave")).agg(F.count("*").alias("documentos"), F.min("md5").alias("primeiro")).filter("documentos > 1")
