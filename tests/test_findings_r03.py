"""Tests of the findings of round 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo import adapter
from acervo.functions import extract as T
from acervo.operators import automaton as A
from acervo.operators import classify as K
from acervo.operators import search as S
from acervo.operators import stats
from acervo.plans.queries import by_term
from acervo.sources import sinks as O
from acervo.streaming.segments import Segments

SF = "/root/testdata/sf0.001"


def test_papers_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(adapter, "PER_FILE", 100)
    orders = adapter.read(spark, SF, "orders")
    assert adapter.dealt(spark, SF).rdd.getNumPartitions() == -(-orders.count() // 100)
    assert adapter.dealt(spark, SF).exceptAll(orders).isEmpty()


def test_detectors_read_one_lowered_text(spark):
    found = K.with_signals(spark.createDataFrame([("a", "Recebi de Ana")], "md5 string, texto string"), "texto")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(texto") == 1


def test_labels_of_any_case_are_found(spark):
    texts = ["CHASSI 9BWZZZ377VT004251", "chaſſi 9BWZZZ377VT004251", "xchassi 9BWZZZ377VT004251", "SÉRIE: 12", "serie: 12", "İdentidade 12345", "Kurso 7", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b, r.c, r.d) for r in rows.select("i", T.found("t", T.after(["Chassi"], r"[A-Z\d]{17}")).alias("a"), T.found("t", T.after(["Série"], r"\d+")).alias("b"), T.found("t", T.after(["Identidade"], r"\d+")).alias("c"), T.found("t", T.after(["Kurso"], r"\d+")).alias("d")).collect()}
    # the same labels without the look at their first letter
    plain = lambda label, value: T.I + r"(?<![\p{L}\d])" + T.either([label]) + T.COLON + f"({value})"
    want = {r.i: (r.a, r.b, r.c, r.d) for r in rows.select("i", *[F.nullif(F.regexp_extract(F.coalesce("t", F.lit("")), plain(*x), 1), F.lit("")).alias(n) for n, x in {"a": ("Chassi", r"[A-Z\d]{17}"), "b": ("Série", r"\d+"), "c": ("Identidade", r"\d+"), "d": ("Kurso", r"\d+")}.items()]).collect()}
    assert got == want and got[0][0] and got[4][1]


def test_total_of_amounts_keeps_its_cents(spark):
    cols = "md5 string, valor_monetario string, tipo_documento string, status_conferencia string, dominio string"
    rows = spark.createDataFrame([("0", "R$ 1.000.000.000.000.000,00", None, None, None), *[(str(i), "R$ 0,01", None, None, None) for i in range(1, 1001)]], cols)
    assert stats.kpis(rows).first().total == 1_000_000_000_000_010.0


def test_numbers_of_entries_do_not_depend_on_how_ranges_are_drawn_together(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionNum": "9"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        id = F.col("id").cast("string")
        rows = spark.range(20_000).select(F.md5(id).alias("md5"), F.sha2(id, 512).alias("nome_arquivo"), *[F.lit(None).cast("string").alias(c) for c in ("status", "tipo_documento", "dominio", "valor_monetario", "curso")], F.sha2(id, 256).alias("beneficiario"))
        got = O.consolidated_report(rows).collect()
        names = {r.nome_arquivo: r.md5 for r in rows.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    told = [names[r.linha.split(" | ")[1]] for r in got[1:]]
    assert [r.pos for r in got] == list(range(20_001)) and told == sorted(names.values())


def test_postings_are_stored_without_dealing_them_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PER_PART", 10)
    docs = spark.range(40).select(F.md5(F.col("id").cast("string")).alias("md5"), F.concat(F.lit("um dois "), F.col("id").cast("string")).alias("texto"))
    stored = S.stored_order(S.build_index(S.dealt(docs), ["texto"]))
    assert S.dealt(docs).rdd.getNumPartitions() == 4
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the texts alone
    index = Segments(spark, str(tmp_path / "index"))
    index.append(docs, ["texto"], 0)
    assert "Join" not in index.postings()._jdf.queryExecution().optimizedPlan().toString()  # nothing came again
    index.append(docs.limit(0).unionByName(docs.filter("texto = 'um dois 7'").withColumn("texto", F.lit("um"))), ["texto"], 1)
    assert {(r.term, r.n) for r in index.postings().groupBy("term").agg(F.count("*").alias("n")).collect()} >= {("um", 40), ("dois", 39)}
    assert {(r.term, r.df, r.cf) for r in by_term(index.postings()).filter("term in ('um', 'dois')").collect()} == {("um", 40, 40), ("dois", 39, 39)}


def test_blocks_of_rules_leave_the_driver_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_LETTERS", 40)
    held, most, broadcast = [], [], type(spark.sparkContext).broadcast

    def count(context, value):
        made = broadcast(context, value)
        gone = made.destroy
        held.append(1)
        most.append(len(held))
        made.destroy = lambda blocking=False: (held.pop(), gone(blocking))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", count)
    terms = spark.createDataFrame([(f"termo {i}", i) for i in range(50)], "t string, id long")
    texts = spark.createDataFrame([(f"d{i}", f"um termo {i} e um termo {i // 2}") for i in range(50)] + [("x", "nada"), ("y", None)], "md5 string, low string")
    got = {r.md5: r.id for r in A.longest_terms(texts, terms).collect()}
    assert got == {f"d{i}": i for i in range(50)} and len(most) > 5 and max(most) == 1 and not held
