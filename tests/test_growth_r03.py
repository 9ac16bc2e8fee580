"""Tests of the findings of round 3 on growth: how many parts, how many passes, how many aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo import adapter
from acervo.functions import extract as T
from acervo.operators import classify as K
from acervo.operators import duplicates as D
from acervo.operators import entities as E
from acervo.operators import pages as P
from acervo.operators import search as S
from acervo.operators import state as R
from acervo.operators import stats
from acervo.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_join_does_not_decide_the_parts_of_the_registry(spark, monkeypatch):
    monkeypatch.setattr(adapter, "PER_FILE", 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = -(-adapter.read(spark, SF, "orders").count() // 100)
        assert n > 4 and [adapter.derived(spark, SF, x).rdd.getNumPartitions() for x in (adapter.REGISTRY, adapter.FORMS)] == [n, n]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_single_pass_makes_only_its_columns(spark, monkeypatch):
    monkeypatch.setattr(adapter, "kept", lambda *a: a[3]() if len(a) > 3 else None)
    assert "texto_digital" in plan(adapter.passed(spark, SF)) and "texto_digital" not in plan(stats.corpus_counters(adapter.passed(spark, SF)))
    kept = adapter.registry(spark, SF)
    assert kept.count() == adapter.passed(spark, SF).count()


def test_pages_lie_in_parts_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(adapter, "LINES", 1000)
    monkeypatch.setattr(adapter, "kept", lambda *a: a[3]())
    made = adapter.pages(spark, SF)
    lines = adapter.read(spark, SF, "lineitem")
    assert made.rdd.getNumPartitions() == -(-lines.count() // 1000)
    assert spark.sql(adapter.PAGES, lineitem=lines).exceptAll(made).isEmpty()


def test_a_file_is_told_in_one_aggregation(spark):
    cols = "md5 string, pagina int, tipo string, dominio string, cpf string, rg string, cnpj string, curso string, numero_cheque string"
    rows = [("a", 1, "Folha de Cheque", "financeiro", "c1", None, None, None, "1"), ("a", 2, "Folha de Cheque", "financeiro", None, None, None, None, "1"), ("b", 1, "Laudo de Vistoria Veicular", "veicular", None, None, None, None, None), ("b", 2, "Guia de Remoção de Veículo", "veicular", None, None, None, None, None), ("b", 3, None, "veicular", None, None, None, None, None)]
    pages = spark.createDataFrame(rows, cols)
    docs = spark.createDataFrame([("a", "x", "y", None), ("c", "x", "y", " ")], "md5 string, tipo_documento string, dominio string, cpf string")
    assert "Expand" not in plan(P.principal(pages))
    assert {r.md5: r.tipo_principal for r in P.principal(pages).collect()} == {"a": "Talão de Cheques", "b": "Dossiê Veicular"}
    whole = P.merge_dossier(docs, pages)
    assert plan(whole).count("Aggregate [") == 1 and "Expand" not in plan(whole)
    got = {r.md5: (r.tipo_documento, r.dominio, r.cpf, r.todos_tipos) for r in whole.collect()}
    assert got == {"a": ("Talão de Cheques", "financeiro", "c1", ["Talão de Cheques", "Folha de Cheque"]), "c": ("x", "y", None, ["x"])}


def test_parties_are_taken_apart_once_for_all_tables(spark, monkeypatch):
    calls, own = [], E.roles
    monkeypatch.setattr(E, "roles", lambda *a: calls.append(a) or own(*a))
    tables = E.relational(adapter.registry(spark, SF))
    assert len(calls) == 1
    assert tables["pessoas_juridicas"].exceptAll(E.companies(adapter.registry(spark, SF))).isEmpty() and tables["pessoas_juridicas"].count() == E.companies(adapter.registry(spark, SF)).count()


def test_plain_searches_before_patterns_change_nothing(spark):
    texts = ["CHASSI 9BWZZZ377VT004251", "chaſſi 9BWZZZ377VT004251", "Vencİmento 1/5/2024", "vencımento: 1/5/2024", "Ano  Calendario: 2020", "R$ 10,00", "r$ 9,99", "itaú", "nada", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    low = F.lower("t")
    asked = [(["Chassi"], r"[A-Z\d]{17}"), (["Vencimento"], r"[\d/]+"), (K.CALENDAR_YEAR[0], K.YEAR), (["R$"], T.AMOUNT)]
    new = [f for labels, value in asked for f in (T.found_after("t", low, labels, value), T.every_after("t", low, labels, value))]
    old = [f for labels, value in asked for f in (T.found("t", T.after(labels, value)), T.every("t", T.after(labels, value)))]
    got = rows.select("i", F.array(*[F.to_json(F.array(x)) for x in new]).alias("x")).collect()
    assert got == rows.select("i", F.array(*[F.to_json(F.array(x)) for x in old]).alias("x")).collect()
    assert sum('"' in y for r in got for y in r.x) == 14
    assert all(any(w in x for w in K.pieces(p)) for p, x in zip(K.BANKS, ["sicoob", "sicredi", "o bb", "bradesco", "itau", "santander", "caixa  economica", "banestes", "brb", "safra", "inter", "nubank"]))


def test_classified_texts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(S, "PER_PART", 50)
    found = queries.QUERIES["text_signatures"](spark, SF)
    assert "RepartitionByExpression [md5" in plan(found)


def test_compared_texts_are_put_into_form_once(spark):
    rows = spark.createDataFrame([("a b c d e", "a b c d e f"), ("a b", "a b"), ("um dois tres quatro", "um dois tres cinco"), ("a b c", "c b"), ("", "x"), (None, "x")], "a string, b string")
    asked = rows.select(D.compare("a", "b").alias("s"))
    assert asked._jdf.queryExecution().analyzed().toString().count("array_intersect") == 1
    assert [r.s for r in asked.collect()] == [0.825, 1.0, 0.3333, 0.0, 0.0, 0.0]
    assert rows.limit(1).select(D.shingles("b").alias("g")).first().g == ["a b c", "b c d", "c d e", "d e f"]


def test_page_changes_meet_their_pages_once(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "RG", "identificacao", "x"), ("b", "CPF", "identificacao", "x")], "md5 string, tipo_documento string, dominio string, outra string")
    pages = spark.createDataFrame([("a", 2, "CPF"), ("a", 1, None), ("a", 2, "RG")], "md5 string, pagina int, tipo string")
    changes = spark.createDataFrame([("a", 2, "CNH"), ("a", 3, "RG"), ("b", 2, None)], "md5 string, pagina long, tipo string")
    out = R.reclassify(docs, pages, changes)
    assert plan(out).count("Join") == 1 and plan(out).count("Aggregate [") == 1
    got = {r.md5: [(p.pagina, p.tipo) for p in r.dossie_paginas] for r in out.collect()}
    assert got == {"a": [(1, None), (2, "CNH"), (2, "CNH")], "b": [(1, "CPF"), (2, "Página 2")]}
    monkeypatch.setattr(adapter, "kept", lambda *a: a[3]() if len(a) > 3 else None)
    assert "texto_digital" not in plan(queries.reclassified(spark, SF))


def test_an_index_is_made_from_tokens_read_once(spark):
    docs = spark.createDataFrame([("a", "b a b", "a"), ("b", None, ""), ("c", "...", "x"), ("d", "", None)], "md5 string, um string, dois string")
    made = S.build_index(docs, ["um", "dois"])
    # one reading for each field, one sort
    assert plan(made).count("regexp_extract_all") == 2 and plan(made).count("sort_array") == 1
    assert sorted((r.term, r.md5, r.field, r.doc_len, r.tf, r.positions) for r in made.collect()) == [("a", "a", "dois", 4, 1, [0]), ("a", "a", "um", 4, 1, [1]), ("b", "a", "um", 4, 2, [0, 2]), ("x", "c", "dois", 1, 1, [0])]
    for rows in (docs, docs.limit(0), docs.filter("md5 = 'b'")):
        told = S.sizes_of(S.build_index(rows, ["um", "dois"]), rows)
        assert told.collect() == S.sizes(rows, ["um", "dois"]).collect() and "regexp_extract_all" not in plan(S.sizes_of(docs.selectExpr("1 as tf"), rows))
