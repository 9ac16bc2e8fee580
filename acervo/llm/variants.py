"""Spelling variants: words one edit apart, found with blocked Gram matrices of letter counts.

Words of one edit have letter counts at a squared distance of at most two: an inserted or deleted
letter makes one, a replaced one two, or nothing where both letters are counted in one of the
BUCKETS.  One matrix product of a block's counts gives the squared distances to many words at once;
pairs at most two apart are then verified letter by letter.

Blocks are exact: a block holds the words with the same number of letters in each of four groups of
letters, hence of one length, and one edit leads into the block itself or one whose numbers
differ by one in one group (the adjacent lengths) or two (the same length).  A unit of work is a
piece of one block, of at most PIECE words, and meets the words of its own block and of the ten
that follow among its neighbours.  Units are streamed in sorted order, the piece first, so
memory holds one piece and one batch, and a common block is many units.

Forms are followed to their last by pointer doubling over written tables.  A form has a multiple
of its word's count, so chains are as long as a logarithm of the largest count.

Defined results: null texts have no words; an empty table gives no rows; words of unlimited
length are kept (pieces hold fewer of them); other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Scratch, shuffle_parts, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
GROUPS, BUCKETS = 4, 32
#: Words, and letters, of a piece; cells of a matrix of distances; candidates that are verified at once.
PIECE, PIECE_LETTERS, CELLS, VERIFY = 4096, 1 << 20, 1 << 20, 1 << 18


def deleted(doc_id: Column, run: Column) -> Column:
    """The contract's slips: where 199 divides h = crc32(id:run), the letter at h % length is missing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, *, id_col="doc_id", text_col="text", min_length: int = 6, min_count: int = 5, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least min_length letters and min_count occurrences.

    change(id, run) is applied to every run that is long enough; it must not make one longer.
    """
    found = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    word = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    word = word.select((change(F.col("id"), F.col("run")) if change else F.col("run")).alias("word")).filter(F.length("word") >= min_length)
    return word.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def group_counts(word: Column) -> list[Column]:
    """Letters of each group, by code point modulo GROUPS; letters beyond the usual ones count in the first."""
    usual = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    rest = [F.length(word) - F.length(F.translate(word, "".join(c for c in usual if ord(c) % GROUPS == k), "")) for k in range(1, GROUPS)]
    return [F.length(word) - sum(rest[1:], rest[0]), *rest]


def block_name(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def units(words: DataFrame) -> DataFrame:
    """(unit, role, word, n): role 0 is a unit's piece, 1 the words of its block, 2 others of its length, 3 those longer by a letter."""
    scratch = Scratch(words.sparkSession, "variants")
    counts = [F.col(f"g{k}") for k in range(GROUPS)]
    known = words.select("word", "n", *[c.alias(f"g{k}") for k, c in enumerate(group_counts(F.col("word")))])
    known = scratch.keep(known.withColumn("block", block_name(counts)), "words")
    room = F.greatest(F.lit(1), F.least(F.lit(PIECE), F.floor(F.lit(PIECE_LETTERS) / sum(counts[1:], counts[0]))))
    blocks = scratch.keep(known.groupBy("block").agg(F.count("*").alias("size"), F.first(room).alias("room")).select("block", F.ceil(F.col("size") / F.col("room")).alias("pieces")), "blocks")
    # the blocks whose pieces a word meets: its own, half of those of its length, those one letter shorter
    moved = []
    for a in range(GROUPS):
        moved.append(F.struct(F.lit(3).alias("role"), block_name([c - 1 if k == a else c for k, c in enumerate(counts)]).alias("block"), (counts[a] > 0).alias("there")))
        for b in range(a + 1, GROUPS):
            moved.append(F.struct(F.lit(2).alias("role"), block_name([c - 1 if k == a else c + 1 if k == b else c for k, c in enumerate(counts)]).alias("block"), (counts[a] > 0).alias("there")))
    home = F.struct(F.lit(1).alias("role"), F.col("block").alias("block"), F.lit(True).alias("there"))
    met = known.select("word", "n", F.explode(F.filter(F.array(home, *moved), lambda x: x["there"])).alias("to")).select("word", "n", "to.role", "to.block")
    met = met.join(blocks.hint("merge"), "block").select("block", "role", "word", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    left = known.join(blocks.hint("merge"), "block").select("block", F.lit(0).alias("role"), "word", "n", F.pmod(F.xxhash64("word"), F.col("pieces")).alias("piece"))
    return left.unionByName(met).select(F.concat_ws("/", "block", "piece").alias("unit"), "role", "word", "n")


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points, a row a word; all words have the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def letter_counts(code: np.ndarray) -> np.ndarray:
    """How often each bucket of letters occurs, a row a word."""
    n, length = code.shape
    flat = np.bincount((np.arange(n)[:, None] * BUCKETS + code % BUCKETS).ravel(), minlength=n * BUCKETS)
    return flat.reshape(n, BUCKETS).astype(np.float32 if length < 1000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words differ by exactly one replaced letter, or by one inserted where b is longer; a row a pair."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    width = a.shape[1]
    lead = np.where(ahead.any(axis=1), ahead.argmax(axis=1), width)
    trail = np.where(behind.any(axis=1), behind[:, ::-1].argmax(axis=1), width)
    return lead + trail >= width


class Piece:
    """The words of a unit's piece, ready to meet others."""

    def __init__(self, words: pa.Array):
        self.words = words
        listed = words.to_pylist()
        self.code = codes(listed, len(listed[0]))
        self.counts = letter_counts(self.code)
        self.squares = (self.counts**2).sum(axis=1)

    def near(self, other: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Rows of self and of other that are one edit apart."""
        found = [np.empty((2, 0), np.int64)]
        wide = max(1, CELLS // len(self.squares))
        for lo in range(0, len(other.squares), wide):
            hi = lo + wide
            # squared distances less |x|^2, so that the threshold takes no pass of its own
            gram = self.counts @ (-2 * other.counts[lo:hi].T)
            gram += other.squares[lo:hi]
            x, y = np.divmod(np.flatnonzero(gram <= (2 - self.squares)[:, None]), gram.shape[1])
            for k in range(0, len(x), VERIFY):
                i, j = x[k : k + VERIFY], y[k : k + VERIFY] + lo
                same = one_edit(self.code[i], other.code[j])
                found.append(np.stack([i[same], j[same]]))
        both = np.concatenate(found, axis=1)
        return both[0], both[1]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words one edit apart, once."""
    spark = words.sparkSession
    small_batches(spark, PIECE)
    ordered = units(words).repartition(shuffle_parts(spark), "unit").sortWithinPartitions("unit", "role", "word")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, held_n, piece, piece_n = None, [], [], None, None
        for batch in batches:
            names, roles = batch.column("unit"), batch.column("role").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = (roles[1:] != roles[:-1]) | pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                rows, name = batch.slice(lo, hi - lo), names[lo].as_py()
                if name != unit:
                    unit, held, held_n, piece = name, [], [], None
                if roles[lo] == 0:
                    held.append(rows.column("word"))
                    held_n.append(rows.column("n"))
                    continue
                if not held:  # no word was dealt into this piece
                    continue
                if piece is None:
                    piece, piece_n = Piece(pa.concat_arrays(held)), pa.concat_arrays(held_n)
                size = max(1, PIECE_LETTERS // piece.code.shape[1])
                for at in range(0, hi - lo, size):
                    part = rows.slice(at, size)
                    other = Piece(part.column("word"))
                    i, j = piece.near(other)
                    a, b = piece.words.take(pa.array(i)), other.words.take(pa.array(j))
                    made = pa.RecordBatch.from_arrays([a, piece_n.take(pa.array(i)), b, part.column("n").take(pa.array(j))], ["a", "a_n", "b", "b_n"])
                    if roles[lo] == 1:  # within its own block a pair meets from either side
                        made = made.filter(pa.compute.less(a, b))
                    if made.num_rows:
                        yield made

    return ordered.mapInArrow(meet, "a string, a_n long, b string, b_n long")


def group(words: DataFrame, *, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    form is the near word of largest n (ties: the smallest word) if that is at least factor * n;
    root follows forms to the last.
    """
    scratch = Scratch(words.sparkSession, "forms")
    words = scratch.keep(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    best = scratch.keep(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "best")
    chosen = F.col("near_n") >= factor * F.col("n")
    known = words.join(best.hint("merge"), "word", "left").select("word", F.when(chosen, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near_n")).alias("form_n"))
    known = scratch.keep(known, "known")
    roots, step = scratch.keep(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{step + 1}")
        roots, step = moved.select("word", "root"), step + 1
        if not moved.filter("moved").limit(1).count():
            break
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(counts: dict[str, int], factor: int = 5) -> list[tuple]:
    """Rows of group() by comparing all pairs, for tests."""

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {a: sorted((-counts[b], b) for b in counts if b != a and near(a, b)) for a in counts}
    form = {a: x[0][1] for a, x in found.items() if x and -x[0][0] >= factor * counts[a]}

    def last(a: str) -> str:
        return last(form[a]) if a in form else a

    return [(a, form.get(a), last(a), counts[a], len(found[a]), counts[form[a]] if a in form else None) for a in counts]
