"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its share of the target volume over the volume it
has.  Each document draws its number of copies from the Poisson distribution with that
mean by inverting the cumulative distribution at a number that a hash of the document
seeds, so draws need no coordination and repeat exactly.  A rate over MOST_RATE is a sum of
equal smaller ones, each drawn with a seed of its own, so a table of the distribution stays
short and no row's copies are ever held together.  Copies are then put in one global random
order.

Defined results: a null source is a source of its own; null or empty texts have no
volume, and a source without volume draws nothing; sources missing from `weights`
weigh `default_weight`; rows equal in id and text draw alike; an empty table gives an
empty result; other columns pass through, and an added column whose name is taken ends in
an underscore.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Scratch, free, shuffle_parts

#: More sources than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 50_000
#: Larger rates are split; the table of one has less than STRIDE entries; pieces are made in blocks.
MOST_RATE, STRIDE, BLOCK = 32, 128, 4096


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 to far beyond the mean, for rates up to MOST_RATE; terms are built in logarithms."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")

    def grow(a, k):
        log = a["log"] + F.log(rate / k)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"), F.concat(a["all"], F.array(a["sum"] + F.exp(log))).alias("all"))

    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, grow)["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source_col="source", text_col="text", default_weight: float = 1.0, volume: float | None = None) -> DataFrame:
    """(source, rate) with rate = target volume of the source / volume it has, in code points."""
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("size"))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in (weights or {}).items())) if weights else None
    weight = F.coalesce(F.element_at(known, F.col("source")), F.lit(default_weight)) if weights else F.lit(default_weight)
    sized = size.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total = sized.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))  # one row
    target = F.col("all") if volume is None else F.lit(float(volume))
    return sized.crossJoin(F.broadcast(total)).select("source", F.when(F.col("weight") > 0, target * F.col("weight") / F.col("weights") / F.col("size")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col="doc_id", source_col="source", text_col="text", seed: str = "mix", scratch: Scratch | None = None, **how) -> DataFrame:
    """docs, each row as often as it drew, with copy and shuffle_key, in the order of shuffle_key.

    copy numbers a row's copies from 1, with gaps where its rate is over MOST_RATE.  The key is
    evenly spread, so its first digits name the partition of a row and nothing need be sampled.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    source, pieces, cdf, own, block, piece, n, part, copy, key = free(docs, "source", "pieces", "cdf", "own", "block", "piece", "n", "part", "copy", "shuffle_key")
    rated = rates(docs, weights, source_col=source_col, text_col=text_col, **how).filter("rate > 0")
    many = F.ceil(F.col("rate") / MOST_RATE)
    by = scratch.keep(rated.select(F.col("source").alias(source), many.alias(pieces), poisson_cdf(F.col("rate") / many).alias(cdf)), "rates")
    sources, most = by.agg(F.count("*"), F.max(pieces)).first()
    by = F.broadcast(by) if sources <= MOST_BROADCAST else by.hint("merge")
    named = docs.withColumn(own, F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    drawn = named.join(by, named[source_col].eqNullSafe(F.col(source))).drop(source)
    if most and most > 1:  # a sequence holds at most BLOCK entries for each of a row's blocks
        drawn = drawn.withColumn(block, F.explode(F.expr(f"sequence(0L, div(`{pieces}` - 1, {BLOCK}L))")))
        drawn = drawn.withColumn(piece, F.explode(F.expr(f"sequence(`{block}` * {BLOCK}L + 1, least((`{block}` + 1) * {BLOCK}L, `{pieces}`))"))).drop(block)
    else:
        drawn = drawn.withColumn(piece, F.lit(1).cast("long"))
    # the number drawn is computed once, as the start of the count
    start = F.struct(uniform(seed, F.col(own), F.col(piece).cast("string")).alias("u"), F.lit(0).alias("n"))
    drawn = drawn.withColumn(n, F.aggregate(cdf, start, lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + (c <= a["u"]).cast("int")).alias("n")))["n"]).drop(cdf, pieces)
    copies = drawn.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).withColumn(copy, F.col(copy) + (F.col(piece) - 1) * STRIDE).drop(n, piece)
    keyed = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.col(own), F.col(copy).cast("string")))).drop(own)
    parts = shuffle_parts(spark)
    dealt = keyed.withColumn(part, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) * parts).cast("int"))
    return dealt.repartitionById(parts, part).drop(part).sortWithinPartitions(key, id_col)
