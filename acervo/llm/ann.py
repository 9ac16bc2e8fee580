"""Approximate nearest neighbours by cross-polytope hashing.

A function turns the unit vector with a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform) and names the signed axis it is nearest to.  A table files vectors
under the axes of several functions, one more for each so many times more vectors, so that
a query's share of all rows falls as the table grows.  A query visits in each table the
sets of axes that its rotated values rank highest, summed over the functions; what it meets
there is ranked by exact Euclidean distance on the original vectors.

Rows are dealt out by the axis of the first function alone; a query takes with it, for each
such axis, a bitmap of the other axes that it visits there.  Equal vectors are collapsed
first (with as many of their smallest ids as an answer can need), so copies cost one entry.
Crowded axes are dealt out in blocks of bounded size; each block hands on only its best
rows for each query, so no bucket is gathered in one task and no pair of vectors becomes
a row.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither do rows with a null id; vectors of different
lengths never meet; ties go to the smaller id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.llm.common import Scratch, row_key

TABLES, SEED = 10, 7
#: Share of a function's axes that a query visits; of k functions it visits this share to the power k of all sets, LEAST at least.
SHARE, LEAST = 0.14, 16
#: Vectors from which on a table has two functions, three, ...
STEPS = (5_000, 2_000_000, 500_000_000)
BLOCK, QUERY_BLOCK = 8192, 1024


def usable(vec: str) -> Column:
    c = F.col(vec)
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """[table, function, vector, signed axis]: the unit vectors' values along every axis (2 * axis, plus 1 on its negative side)."""
    n, d = x.shape
    wide = 1 << max(0, d - 1).bit_length()
    unit = np.zeros((n, wide))
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    unit[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, wide]).choice([-1.0, 1.0], (tables, functions, 3, wide))
    out = np.empty((tables, functions, n, 2 * wide))
    for t in range(tables):
        for f in range(functions):
            y = unit
            for r in range(3):
                y = _hadamard(y * signs[t, f, r])
            out[t, f, :, 0::2], out[t, f, :, 1::2] = y, -y
    return out


def filed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[table, vector]: the first function's axis, and the others' axes as one number."""
    axes, wide = values.argmax(3), values.shape[3]
    rest = np.zeros(axes[:, 0].shape, np.int64)
    for f in range(1, axes.shape[1]):
        rest = rest * wide + axes[:, f]
    return axes[:, 0], rest


def visited(values: np.ndarray, share: float = SHARE) -> np.ndarray:
    """[vector, set]: the sets of axes (as numbers, the first function's axis leading) with the highest sums of values, for one table."""
    functions, n, wide = values.shape
    score, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for f in range(functions):
        most = max(LEAST, round((share * wide) ** (f + 1) * 1.15))
        score = (score[:, :, None] + values[f][:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * wide + np.arange(wide)).reshape(n, -1)
        # a set among the best has its first axes among the best of all sets that begin with them
        keep = min(score.shape[1], most if f == functions - 1 else wide ** (f + 1))
        if keep < score.shape[1]:
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
    return code


def _matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    return [(rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def _hashed(rows: DataFrame, functions: int, asking: bool, tables: int, seed: int) -> DataFrame:
    """rows (key, vec, ...) for each table and first axis that they are filed under or visit, with bucket = (length, table, axis).

    rest: the other axes as a number, or a bitmap of those that a query visits.
    """
    step = max(1, 2000 >> (7 * (functions - 1))) if asking else 500

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                part = part.take(pa.array(np.arange(part.num_rows)))  # offsets from zero
                for own, x in _matrices(part.column(part.schema.get_field_index("vec"))):
                    values = rotated(x, tables, functions, seed)
                    room = values.shape[3] ** (functions - 1)
                    for t in range(tables):
                        if asking:
                            index, axis, rest = [], [], []
                            for i, sets in enumerate(visited(values[t])):
                                first, other = np.divmod(np.sort(sets), room)
                                edges = np.flatnonzero(np.diff(first, prepend=-1))
                                for a, b in zip(edges, [*edges[1:], len(first)]):
                                    bits = np.zeros(room, np.uint8)
                                    bits[other[a:b]] = 1
                                    index.append(own[i])
                                    axis.append(first[a])
                                    rest.append(np.packbits(bits).tobytes())
                            rest = pa.array(rest, pa.binary())
                        else:
                            index, (axis, rest) = own, (v[0] for v in filed(values[t : t + 1]))
                            rest = pa.array(rest)
                        bucket = (x.shape[1] * tables + t) * (1 << 24) + np.asarray(axis, np.int64)
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(index)).columns, pa.array(bucket), rest], [*part.schema.names, "bucket", "rest"])

    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("rest", T.BinaryType() if asking else T.LongType())])
    return rows.mapInArrow(run, schema)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, without overflow for huge components."""
    gap = x - q
    most = np.abs(gap).max(1)
    safe = np.where((most > 1e150) & np.isfinite(most), most, 1.0)[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        return safe[:, 0] * np.sqrt(((gap / safe) ** 2).sum(1))


def _nearest(data: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best entries (and their ties) of one block for each query of one block, among those whose other axes it visits."""
    schema = pa.schema([("query", pa.string()), ("key", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
    if not data.num_rows or not asked.num_rows:
        return schema.empty_table()
    (_, x), (_, q) = _matrices(data.column("vec"))[0], _matrices(asked.column("vec"))[0]
    rest, i, j, score = data.column("rest").to_numpy(), [], [], []
    for n, bits in enumerate(asked.column("rest").to_pylist()):
        met = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[rest])
        if len(met):
            exact = distances(x[met], q[n])
            near = np.flatnonzero(exact <= np.partition(exact, min(k, len(met)) - 1)[min(k, len(met)) - 1])
            i.append(np.full(len(near), n))
            j.append(met[near])
            score.append(exact[near])
    if not i:
        return schema.empty_table()
    i, j, score = (np.concatenate(v) for v in (i, j, score))
    return pa.table({"query": asked.column("key").take(pa.array(i)), "key": data.column("key").take(pa.array(j)), "score": pa.array(score), "ids": data.column("ids").take(pa.array(j))}).cast(schema)


def _best(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def _blocks(hashed: DataFrame, size: int, name: str) -> DataFrame:
    """How many blocks of about `size` rows each bucket is dealt into."""
    return hashed.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col="vec_id", vec_col="embedding", tables: int = TABLES, functions: int | None = None, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest found among vectors, itself left out.

    functions: of each table; chosen by the number of vectors if not given.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "ann")

    def entries(df):
        known = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & usable("vec"))
        return known.withColumn("key", row_key("vec"))

    rows, asked = entries(vectors), entries(queries)
    few = _best(rows.dropDuplicates(["key", "id"]), "key", ["id"], k + 1)
    data = few.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))
    data = scratch.keep(data, "vectors")
    if functions is None:
        functions = 1 + bisect_right(STEPS, data.count())
    data = scratch.keep(_hashed(data, functions, False, tables, seed), "data")
    wanted = scratch.keep(_hashed(asked.groupBy("key").agg(F.first("vec").alias("vec")), functions, True, tables, seed), "queries")
    # one row for each bucket: 2 * padded length * tables of them for each length of vector
    plan = _blocks(data, BLOCK, "n").join(_blocks(wanted, QUERY_BLOCK, "m").hint("merge"), "bucket")
    dealt = data.join(plan.hint("merge"), "bucket").select("bucket", F.pmod(F.xxhash64("key"), "n").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("part"), "key", "vec", "rest", "ids")
    spread = wanted.join(plan.hint("merge"), "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64("key"), "m").alias("part"), "key", "vec", "rest")
    place = ["bucket", "block", "part"]
    met = dealt.groupBy(place).cogroup(spread.groupBy(place)).applyInArrow(lambda a, b: _nearest(a, b, k + 1), "query string, key string, score double, ids array<bigint>")
    # the same vector may be met in several tables
    kinds = met.groupBy("query", "key").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    top = _best(kinds.withColumn("least", F.element_at("ids", 1)), "query", ["score", "least"], k + 1)
    near = _best(top.select("query", "score", F.explode("ids").alias("vec_id")), "query", ["score", "vec_id"], k + 1).drop("rank")
    own = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query")).distinct()
    found = own.join(near.hint("merge"), "query").filter("vec_id != query_id")
    return _best(found, "query_id", ["score", "vec_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
