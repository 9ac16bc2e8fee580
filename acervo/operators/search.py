"""Full-text search over an inverted index kept as a table (FTS-1..6, JOI-1)."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import text as X

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(X.fold(text), F.lit(TOKEN), 0)


def build_index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """FTS-1: postings (term, md5, field, doc_len, tf, positions).

    A document's postings are made inside its row: its tokens sorted with their positions, cut
    where the term changes, so nothing is shuffled to build them and nothing leaves the JVM.
    """
    words = F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("w")) for f in fields])
    with_length = X.let(words, lambda all: X.let(F.aggregate(all, F.lit(0), lambda n, f: n + F.size(f["w"])), lambda n: F.transform(all, lambda f: F.struct(f["field"].alias("field"), f["w"].alias("w"), n.alias("doc_len")))))
    listed = docs.select("md5", F.explode(with_length).alias("f")).filter(F.size("f.w") > 0)
    placed = listed.select("md5", "f.field", "f.doc_len", F.sort_array(F.transform("f.w", lambda w, i: F.struct(w.alias("term"), i.alias("p")))).alias("all"))
    cut = placed.withColumn("starts", F.expr("filter(sequence(1, size(all)), i -> i = 1 OR element_at(all, i).term <> element_at(all, if(i = 1, 1, i - 1)).term)"))
    each = F.expr("transform(starts, (a, k) -> struct(element_at(all, a).term AS term, transform(slice(all, a, coalesce(get(starts, k + 1), size(all) + 1) - a), x -> x.p) AS positions))")
    return cut.select("md5", "field", "doc_len", F.explode(each).alias("e")).select("e.term", "md5", "field", "doc_len", F.size("e.positions").cast("long").alias("tf"), "e.positions")


#: Documents whose postings one task makes and sorts: they stay within its memory.
PER_PART = 4000


def dealt(docs: DataFrame) -> DataFrame:
    """Documents in as many parts as their number asks for, so that their postings need not be dealt out."""
    return docs.repartition(-(-docs.count() // PER_PART) or 1, "md5")


def spread(docs: DataFrame) -> DataFrame:
    """Documents in parts of PER_PART or so: dealt out only where one task would read many of them and more than twice its share, as where one file holds them all."""
    most, total = docs.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    return docs if most <= 2 * max(PER_PART, total // docs.sparkSession.sparkContext.defaultParallelism) else dealt(docs)


def stored_order(postings: DataFrame) -> DataFrame:
    """Postings as they are best written: every file sorted, so that a search reads the row groups of its terms; none is sent to another task."""
    return postings.sortWithinPartitions("term", "md5")


def sizes(docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    n = sum((F.size(tokens(f)) for f in fields), F.lit(0))
    return docs.agg(F.count("*").alias("docs"), F.avg(n).alias("mean"))


def sizes_of(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """sizes() of documents whose index is there: every token is in one posting, so no text is read again."""
    tokens_of = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))
    return docs.agg(F.count("*").alias("docs")).crossJoin(F.broadcast(tokens_of)).select("docs", F.when(F.col("docs") > 0, F.try_divide("n", "docs")).alias("mean"))


def parse(query: str) -> list[tuple[str, str, list[str]]]:
    """FTS-2, FTS-5: (operator, kind, words): plain words are required prefixes; AND, OR, NOT, "phrases" and word* are read as such.

    A query with an open quote is one phrase.
    """
    fold = lambda s: re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn"))
    if query.count('"') % 2:
        return [("AND", "phrase", fold(query))] if fold(query) else []
    special = bool(re.search(r'\b(AND|OR|NOT)\b|"|\*', query))
    out, op = [], "AND"
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if word in ("AND", "OR", "NOT"):
            op = word
            continue
        w = fold(phrase or word)
        if w:
            out.append((op, "phrase" if phrase or len(w) > 1 else "prefix" if not special or word.endswith("*") else "word", w))
        op = "AND"
    return out


def _hits(postings: DataFrame, kind: str, words: list[str], n: int) -> DataFrame:
    """(md5, tf) of one part of a query, tagged n."""
    if kind == "phrase" and len(words) > 1:
        at = reduce(lambda a, b: a.join(b.hint("merge"), ["md5", "field", "start"]), [postings.filter(F.col("term") == w).select("md5", "field", "doc_len" if i == 0 else F.lit(0).alias(f"_{i}"), F.explode(_shifted(i)).alias("start")) for i, w in enumerate(words)])
        return at.groupBy("md5").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len")).withColumn("part", F.lit(n))
    test = F.col("term").startswith(words[0]) if kind == "prefix" else F.col("term") == words[0]
    return postings.filter(test).groupBy("md5").agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len")).withColumn("part", F.lit(n))


def _shifted(i: int) -> Column:
    return F.transform("positions", lambda p: p - i)


def search(postings: DataFrame, stats: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """FTS-2, FTS-3: (md5, fts_score), best (most negative) first, by BM25 over the parts of the query."""
    parts = parse(query)
    spark = postings.sparkSession
    if not parts:
        return spark.createDataFrame([], "md5 string, fts_score double")
    hits = reduce(lambda a, b: a.unionByName(b), [_hits(postings, k, w, i) for i, (_, k, w) in enumerate(parts)])
    df = hits.groupBy("part").agg(F.count("*").alias("df"))  # a row per part of the query
    rows = hits.join(F.broadcast(df), "part").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean")))
    negative = [i for i, (op, _, _) in enumerate(parts) if op == "NOT"]
    found = rows.groupBy("md5").agg(F.sum(F.when(~F.col("part").isin(negative), weight).otherwise(0.0) if negative else weight).alias("s"), F.collect_set("part").alias("parts"))
    test = None
    for i, (op, _, _) in enumerate(parts):
        has = F.array_contains("parts", i)
        test = (~has if op == "NOT" else has) if test is None else test | has if op == "OR" else test & ~has if op == "NOT" else test & has
    out = found.filter(test).select("md5", (-F.col("s")).alias("fts_score")).orderBy("fts_score", "md5")
    return out if limit is None else out.limit(limit)


def snippet(text: Column | str, query: str, size: int = 15) -> Column:
    """FTS-4: the `size` words in which most different words of the query meet, its hits marked.

    The positions of all query words are merged into one list; of the windows that begin at a hit
    the one with the most different words counts, then the one with the most hits, then the first, and
    it is shown with its hits in the middle.
    """
    tests = [(kind, w) for op, kind, ws in parse(query) if op != "NOT" for w in ws]

    def is_hit(word: Column, kind: str, wanted: str) -> Column:
        return F.exists(tokens(word), lambda t: t.startswith(wanted) if kind == "prefix" else t == wanted)

    def hits(raw: Column) -> Column:
        at = lambda w, i: F.array_compact(F.array(*[F.when(is_hit(w, k, x), F.struct(i.alias("p"), F.lit(j).alias("word"))) for j, (k, x) in enumerate(tests)]))
        return F.flatten(F.transform(raw, at))

    def best(found: Column) -> Column:
        def window(h: Column, i: Column) -> Column:
            inside = F.filter(F.slice(found, i + 1, size * len(tests)), lambda x: x["p"] < h["p"] + size)
            return F.struct(F.size(F.array_distinct(inside["word"])).alias("words"), F.size(inside).alias("hits"), (-h["p"]).alias("first"), F.element_at(inside, -1)["p"].alias("last"))

        return F.array_max(F.transform(found, window))

    def show(raw: Column, found: Column, w: Column) -> Column:
        middle = -w["first"] - F.floor((size - (w["last"] + w["first"] + 1)) / 2)
        start = F.greatest(F.lit(0), F.least(F.coalesce(middle, F.lit(0)), F.size(raw) - size)).cast("int")
        shown = F.transform(F.slice(raw, start + 1, size), lambda x, i: F.when(F.array_contains(found["p"], i + start), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
        return F.concat(F.when(start > 0, "... ").otherwise(""), F.array_join(shown, " "), F.when(F.size(raw) > start + size, " ...").otherwise(""))

    if not tests:
        return X.col(text).cast("string")
    raw = F.filter(F.split(X.col(text), r"\s+"), lambda w: w != "")
    return X.let(raw, lambda r: X.let(hits(r), lambda h: X.let(best(h), lambda w: show(r, h, w))))


def search_registry(docs: DataFrame, postings: DataFrame, stats: DataFrame, query: str, text_col: str, limit: int = 50) -> DataFrame:
    """JOI-1: the best rows with score and snippet; at most `limit` hits are broadcast."""
    hits = search(postings, stats, query, limit)
    return docs.join(F.broadcast(hits), "md5").withColumn("fts_snippet", snippet(text_col, query)).orderBy("fts_score", "md5")


def update_index(postings: DataFrame, changed: DataFrame, fields: list[str]) -> DataFrame:
    """FTS-6: the index with the changed documents' postings replaced."""
    return postings.join(changed.select("md5"), "md5", "left_anti").unionByName(build_index(changed, fields))
