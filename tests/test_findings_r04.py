"""Tests of the findings of round 4."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from acervo.operators import automaton as A
from acervo.operators import duplicates as D
from acervo.operators import search as S


def longest(terms: dict[str, int], text: str) -> tuple[int, int]:
    holds = [(len(t), i) for t, i in terms.items() if (re.search(r"\b" + re.escape(t) + r"\b", text) if len(t) <= A.SHORT else t in text)]
    return max(holds, default=(0, 0))


def looked(texts: list[str], blocks: list[dict]) -> list[tuple[int, int]]:
    size, best = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for block in blocks:
        A.look([A.letters(t.encode()) for t in texts], size, best, block)
    return list(zip(size.tolist(), best.tolist()))


def test_texts_leave_with_their_longest_term(spark, monkeypatch):
    # the rules fill many blocks; a text with a long term must not be written anew for the shorter ones
    monkeypatch.setattr(A, "BLOCK_LETTERS", 60)
    terms = spark.createDataFrame([(f"termo numero {i:02d}", i) for i in range(10)] + [(f"curto {i:02d}", 100 + i) for i in range(30)], "t string, id long")
    texts = spark.createDataFrame([(f"d{i}", f"curto {i:02d} e termo numero {i:02d}") for i in range(10)] + [("so", "um curto 29"), ("nada", "nada"), ("", None)], "md5 string, low string")
    asked, own = [], A.packed
    monkeypatch.setattr(A, "packed", lambda *a: asked.append(len(a[0])) or own(*a))
    got = {r.md5: (r.size, r.id) for r in A.longest_terms(texts, terms).collect()}
    assert got == {**{f"d{i}": (15, i) for i in range(10)}, "so": (8, 129)} and len(asked) > 4 and sum(asked) == 40


def test_lengths_of_a_class_are_found_in_one_search():
    rng = random.Random(6)
    word = lambda n, of="ab .é𝄞": "".join(rng.choice(of) for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(200)]
    terms = {t: i for i, t in enumerate({word(rng.randint(1, 9)) for _ in range(200)} | {t[i : i + n] for t in texts[::7] for i, n in ((0, 12), (3, 17), (5, 31)) if len(t) >= i + n})}
    want = [longest(terms, t) for t in texts]
    assert len({n for n, _ in want}) > 8
    names = list(terms)
    block = A.packed(pa.array(names), np.array(list(terms.values())))
    assert looked(texts, [block]) == want
    # in several blocks, and with hashes that tell nothing
    by = sorted(names, key=len, reverse=True)
    assert looked(texts, [A.packed(pa.array(x), np.array([terms[t] for t in x])) for x in (by[:30], by[30:90], by[90:])]) == want
    for kind in block["classes"]:
        kind["table"] = np.ones(2, bool), np.uint64(63)
    assert looked(texts, [block]) == want


def test_equal_hashes_are_told_by_their_letters():
    block = A.packed(pa.array(["abcdef", "uvwxyz"]), np.array([1, 2]))
    (kind,) = block["classes"]
    kind["table"], kind["lengths"][0]["hash"][:] = (np.ones(2, bool), np.uint64(63)), (codes := A.Texts([A.letters(b"uvwxyz")], np.zeros(1, int), {})).sums[6]
    assert len(codes.codes) == 6 and looked(["uvwxyz", "abcdeg"], [block]) == [(6, 2), (0, 0)]


def test_blocks_follow_the_lengths(monkeypatch):
    monkeypatch.setattr(A, "BLOCK_LETTERS", 100)
    assert A._blocks([(50, 1), (40, 1), (30, 1), (10, 25), (500, 1), (5, 3)]) == [(50, 0, 1), (40, 0, 1), (30, 1, 1), (10, 2, 3), (500, 5, 1), (5, 6, 1)]


def family(spark, n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
    texts = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(t))
    lone = [" ".join(f"{k}y{i}" for i in range(30)) for k in range(40)]
    return spark.createDataFrame([(f"{i:03d}", t, "1" if i % 9 == 0 else ("2" if i % 9 == 1 else None)) for i, t in enumerate(dict.fromkeys(texts + lone))], "md5 string, texto string, cpf string")


def by_pairs(docs):
    """Similar pairs as SQL would find them: all grams meet."""
    kinds = D._keep(D.classes(docs), "t")
    g = lambda p: kinds.select(F.col("rep").alias(p), F.col("words").alias(f"w{p}"), F.col("cpf").alias(f"c{p}"), F.col("n").alias(f"n{p}"), F.explode("grams").alias("g"), F.col("head").alias(f"h{p}"))
    met = g("a").join(g("b"), "g").filter("a < b").groupBy("a", "b", "wa", "wb", "ca", "cb", "na", "nb", "ha", "hb").agg(F.count("*").alias("i"))
    near = met.filter("i / (na + nb - i) >= 0.6 and least(wa, wb) / greatest(wa, wb) >= 0.65 and (ca = '' or cb = '' or ca = cb)")
    return {(r.a, r.b, r.j, r.s) for r in near.select("a", "b", F.expr("i / (na + nb - i)").alias("j"), D.char_ratio(F.col("ha"), F.col("hb")).alias("s")).collect()}


def test_families_are_compared_without_writing_pairs(spark, monkeypatch):
    docs, kept = family(spark, 70), []
    want, own = by_pairs(docs), D._keep
    assert len(want) > 900
    monkeypatch.setattr(D, "_keep", lambda df, name: kept.append((name, df)) or own(df, name))
    for block, few, step, part in ((4000, 16, 256, 2048), (7, 2, 3, 5), (25, 16, 10, 64)):
        for name, value in (("FEW", few), ("STEP", step), ("SLICE", part)):
            monkeypatch.setattr(D, name, value)
        kept.clear()
        pairs = D.similar_pairs(D.classes(docs), block=block)
        assert {(r.a, r.b, r.jaccard, r.letters) for r in pairs.collect()} == want
        # what is written are classes, entries and links of trees, fewer than the pairs
        assert max(own(df, "again").count() for name, df in kept if name.startswith("links")) < len(want)
    assert {(r.a, r.b) for r in D.similar_pairs(D.classes(docs), letters=False).collect()} == {x[:2] for x in want}


def test_forests_of_a_gram_have_its_components(monkeypatch):
    rng = np.random.default_rng(2)
    kind, n = rng.permutation(40).astype(np.int64), rng.integers(10, 60, 40)
    pos = (n * rng.random(40) * 0.4).astype(np.int64)
    near = D._near(pos[:, None], n[:, None], pos, n, 0.6) & ~np.eye(40, dtype=bool)
    reach = np.linalg.matrix_power(near.astype(int) + np.eye(40, dtype=int), 6) > 0
    reach = (reach.astype(int) @ reach.astype(int) @ reach.astype(int)) > 0
    want = {(int(min(kind[reach[i]])), int(kind[i])) for i in range(40)} - {(int(k), int(k)) for k in kind}
    for most in (1000, 0):
        monkeypatch.setattr(D, "MATRIX", most)
        a, b = D._forest(kind, pos, n, 0.6)
        assert set(zip(a.tolist(), b.tolist())) == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.rep: r.root for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert D.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_dealt_only_where_one_task_would_read_many(spark, monkeypatch):
    docs, one = (spark.range(100, numPartitions=n).select(F.md5(F.col("id").cast("string")).alias("md5")) for n in (4, 1))
    assert S.spread(docs) is docs and S.spread(one) is one and S.spread(docs.limit(0)).count() == 0
    monkeypatch.setattr(S, "PER_PART", 10)
    assert S.spread(docs) is docs and S.spread(one).rdd.getNumPartitions() == 10


def test_shingles_are_sorted_in_parts_by_their_number(spark, monkeypatch):
    kinds = D._keep(D.classes(family(spark, 20)), "t")
    monkeypatch.setattr(D, "GRAMS", 50)
    n = kinds.agg(F.sum("n")).first()[0]
    plan = D.prefix_index(kinds)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [g#" in plan and f", {-(-n // 50)}" in plan
