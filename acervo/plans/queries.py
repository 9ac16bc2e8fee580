"""Registered queries of the library: each runs one operator over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo import adapter
from acervo.functions import classes as C
from acervo.functions import extract as T
from acervo.functions import text as X
from acervo.operators import classify as K
from acervo.operators import duplicates as D
from acervo.operators import entities as E
from acervo.operators import filters as L
from acervo.operators import pages as P
from acervo.operators import search as S
from acervo.operators import state as R
from acervo.operators import stats
from acervo.sources import files as I
from acervo.sources import publish as W
from acervo.sources import sinks as O
from acervo.sources.tables import kept, shared_dir, written
from acervo.streaming import intake as N
from acervo.streaming import progress as G
from acervo.streaming.segments import Segments, index_stream

Query = Callable[[SparkSession, str], DataFrame]


def over(table: Callable[[SparkSession, str], DataFrame], operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir))


def exported(tables: dict[str, DataFrame]) -> Callable[[str | None], DataFrame]:
    """Tables as CSV in a folder of their own, published; what is asked of it by name, or its manifest."""
    spark = next(iter(tables.values())).sparkSession
    root = f"{shared_dir(spark)}/acervo-export-{uuid.uuid4().hex}"
    W.publish(tables, root)
    return lambda name: W.manifest(spark, root) if name is None else W.published(spark, root, name)


def on_disk(d: DataFrame) -> DataFrame:
    """Files of a registry's documents: half in a folder, a quarter by their names alone, the rest lost."""
    place = F.substring("md5", 1, 1)
    return d.select(F.when(place < "8", F.concat(F.lit("pasta/"), "nome_arquivo")).when(place < "c", F.col("nome_arquivo")).alias("caminho")).filter("caminho is not null")


QUERIES: dict[str, Query] = {
    name: over(adapter.registry, f)
    for name, f in {
        "kpis": stats.kpis,
        "class_distribution": stats.class_distribution,
        "top_classes": lambda d: stats.class_distribution(d, 8),
        "value_counts": stats.value_counts,
        "preponderant_domain": stats.preponderant_domain,
        "flag_counts": stats.flag_counts,
        "value_brackets": stats.value_brackets,
        "distinct_entities": stats.distinct_entities,
        "distinct_valid_entities": lambda d: stats.distinct_entities(d, True),
        "top_holders": stats.top_holders,
        "temporal_distribution": stats.temporal,
        "reliability_tiers": stats.reliability,
        "metadata_quality": stats.quality,
        "domain_chart": stats.domain_chart,
        "type_top7_rest": stats.type_chart,
        "hours_buckets": stats.hours_chart,
        "timeline": stats.timeline,
        "top_institutions": stats.top_institutions,
        "top_people": stats.top_people,
        "funnel": stats.funnel,
        "pivot_domain_review": stats.pivot_domain_review,
        "pivot_class_bracket": stats.pivot_class_bracket,
        "institution_unify": stats.unification,
        "institution_samples": stats.unification_samples,
        "run_summary": stats.run_summary,
        "bi_csv": stats.bi_csv,
        "bi_summary": stats.bi_summary,
    }.items()
}

# these pass over a few columns of the registry once
QUERIES |= {
    name: over(adapter.passed, f)
    for name, f in {
        "level_chart": stats.level_chart,
        "pivot_level_type": stats.pivot_level_type,
        "corpus_counters": stats.corpus_counters,
        "entity_companies": lambda d: E.companies(d).withColumn("documentos_md5", F.array_join("documentos_md5", ";")),
    }.items()
}

SELECTED = {"dominio": ["academico", "financeiro"], "status": ["pendente"], "formato": ["pdf", "word"], "natureza": ["Nada"]}

QUERIES |= {
    name: over(adapter.registry, f)
    for name, f in {
        "cpf_validation": lambda d: d.select("md5", X.format_cpf("cpf").alias("cpf"), X.valid_cpf("cpf").alias("valido"), X.valid_cpf("cpf", True).alias("estrito")),
        "cnpj_validation": lambda d: d.select("md5", X.format_cnpj("cnpj").alias("cnpj"), X.valid_cnpj("cnpj").alias("valido")),
        "money_parse": lambda d: d.select("md5", X.parse_money("valor_monetario").alias("valor"), X.format_brl(X.parse_money("valor_monetario")).alias("texto")),
        "year_extract": lambda d: d.select("md5", X.extract_year("data").alias("ano")),
        "hours_extract": lambda d: d.select("md5", X.extract_hours("carga_horaria").alias("horas")),
        "fold_text": lambda d: d.select("md5", X.fold("tipo_documento").alias("tipo"), X.fold("faculdade").alias("faculdade")),
        "path_parts": lambda d: d.select("md5", X.sanitize_part("beneficiario").alias("parte")),
        "institution_names": lambda d: d.select("md5", X.normalize_institution("faculdade").alias("instituicao")),
        "rule_domains": lambda d: d.select("md5", C.type_to_domain("tipo_documento").alias("dominio")),
        "default_domains": lambda d: d.select("md5", C.default_domain("tipo_documento", "valor_monetario").alias("dominio")),
        "format_classes": lambda d: d.select("md5", C.format_class("extensao", "nome_arquivo").alias("formato")),
        "tag_categories": lambda d: d.groupBy("tipo_documento").agg(F.count("*").alias("documentos")).withColumn("categoria", C.tag_category("tipo_documento")),
        "type_sets": lambda d: L.with_types(d).select("md5", F.array_join("todos_tipos", "|").alias("tipos")),
        "point_lookup": lambda d: L.get(d, " C4CA4238A0B923820DCC509A6F75849B ").select("md5", "nome_arquivo"),
        "unprocessed": lambda d: d.select("md5", L.is_unprocessed().alias("nao_processado")),
        "review_buckets": L.review_buckets,
        "token_search": lambda d: L.token_search(d, "Diplôma 2024").select("md5"),
        "token_search_ids": lambda d: L.token_search(d, "certificado 05-03").select("md5"),
        "domain_filter": lambda d: L.with_types(d).filter(L.domain_filter("financeiro")).select("md5"),
        "quick_view_pending": lambda d: L.quick_view(d, "pendentes").select("md5"),
        "macro_tags": lambda d: L.with_types(d).agg(*[F.count_if(C.macro_tag(t, "todos_tipos", "dominio", "cnpj")).alias(t) for t in C.MACROS]),
        "facet_counts": lambda d: L.facet_counts(d, SELECTED),
        "subtags": lambda d: d.select("md5", F.array_join(L.subtags(), "|").alias("etiquetas")),
        "escalation_reasons": lambda d: L.with_types(d).groupBy(F.coalesce(L.escalation_reason(), F.lit("nenhum")).alias("motivo")).agg(F.count("*").alias("documentos")),
        "final_status": lambda d: d.select("md5", L.final_status()[0].alias("status"), L.final_status()[1].alias("mensagem")),
        "scope_classified": lambda d: stats.kpis(L.bi_scope(d, "classified", "financeiro")),
        "active_fields": lambda d: L.active_fields(d).groupBy("chave").agg(F.count("*").alias("documentos")),
        "gallery_page": lambda d: L.gallery(d, "data_desc", 20, 50).select("md5", "data"),
        "gallery_pending": lambda d: L.gallery(d, "pendentes", 0, 50).select("md5"),
        "master_values": L.master_values,
    }.items()
}

KEEPING = ["beneficiario", "cpf", "valor_monetario", "faculdade"]
COMPARED = ["tipo_documento", "dominio", "cpf", "rg", "cnpj", "beneficiario", "curso", "natureza_curso", "carga_horaria", "faculdade", "valor_monetario", "data"]
CHANGED = ["md5", "nome_arquivo", "tipo_documento", "beneficiario", "cpf", "valor_monetario", "faculdade", "status", "status_conferencia"]


def _part(df: DataFrame, digits: str) -> DataFrame:
    """Rows whose md5 begins with one of the hex digits: two overlapping parts make an old registry and a batch."""
    return df.filter(F.substring("md5", 1, 1).isin(*digits))


def _batch(df: DataFrame) -> DataFrame:
    new = _part(df.select(CHANGED), "89abcdef")
    return new.withColumns({"beneficiario": F.when(F.substring("md5", 2, 1) < "8", F.lit("Novo Titular")), "valor_monetario": F.when(F.substring("md5", 2, 1) >= "c", F.lit("R$ 1,00")), "status": F.lit("sucesso"), "tipo_documento": F.when(F.substring("md5", 2, 1) == "f", F.col("tipo_documento"))})


def _files(df: DataFrame) -> DataFrame:
    twice = df.withColumn("folder", F.explode(F.array(F.lit("b"), F.lit("a"))))
    return twice.select(F.when(F.substring("md5", 1, 1) < "4", F.md5(F.reverse("md5"))).otherwise(F.col("md5")).alias("md5"), F.concat_ws("/", "folder", "nome_arquivo").alias("caminho"))


def _some(df: DataFrame) -> DataFrame:
    return df.filter(F.substring("md5", 1, 2) < "20").select("md5")


QUERIES |= {
    name: over(adapter.registry, f)
    for name, f in {
        "dossier_clusters": E.dossiers,
        "dossier_documents": lambda d: E.dossier_documents(d).select("id", F.array_join("documentos", ",").alias("documentos")),
        "entity_links": E.links,
        "entity_people": lambda d: E.people(d).withColumn("documentos_md5", F.array_join("documentos_md5", ";")),
        "entity_addresses": E.addresses,
        "entity_documents": E.document_rows,
        "organize_plan": E.organize_plan,
        "organized_files": lambda d: E.organize(d.withColumn("caminho_relativo", F.concat(F.lit("pasta/"), "nome_arquivo")), on_disk(d)),
        "published_people": lambda d: exported({"pessoas_fisicas": E.people(d)})("pessoas_fisicas"),
        "published_manifest": lambda d: exported(E.relational(d))(None).select("tabela", "linhas"),
        "archive_names": lambda d: E.archive_names(d.select("md5", F.concat(F.coalesce("tipo_documento", F.lit("sem")), F.lit(".pdf")).alias("nome_arquivo"))),
        "incremental_plan": lambda d: R.plan(_files(d), d),
        "reprocess_plan": lambda d: R.plan(_files(d), d, "reprocess_ocr"),
        "force_plan": lambda d: R.plan(_files(d), d, "force").groupBy("acao").agg(F.count("*").alias("documentos")),
        "upsert_merge": lambda d: R.upsert(_part(d.select(CHANGED), "0123456789ab"), _batch(d), KEEPING),
        "review_update": lambda d: R.set_review(d.select(CHANGED), _some(d), "aprovado"),
        "bulk_retag": lambda d: R.retag(d, _some(d), tipo="Diploma", dominio="academico", faculdade="ABC - faculdade nova").select("md5", "tipo_documento", "dominio", "faculdade"),
        "preserved_review": lambda d: R.preserve_review(d.select(CHANGED).drop("status_conferencia"), d).select("md5", "status_conferencia"),
        "unified_registry": lambda d: R.unify_institutions(d).select("md5", "faculdade"),
        "registry_reconcile": lambda d: R.reconcile(_part(d.select(CHANGED), "0123456789"), _part(d.select(CHANGED), "789abcdef")),
        "placeholders": lambda d: R.placeholders(d.select("md5", F.concat(F.coalesce("tipo_documento", F.lit("sem nome")), F.lit(".pdf")).alias("nome_arquivo")), d.filter("eh_nativo_digital")),
        "type_removed": lambda d: L.with_types(d).withColumns(R.remove_type("Recibo")).select("md5", "tipo_documento", "dominio", F.array_join("todos_tipos", "|").alias("tipos")),
        "pix_removed": lambda d: R.remove_pix(L.with_types(d)).select("md5", "tipo_documento", "dominio"),
        "type_added": lambda d: L.with_types(d).select("md5", F.array_join(R.add_type("RG"), "|").alias("tipos")),
        "duplicate_fields": lambda d: R.compare_pairs(d.filter("duplicata_de is not null").select(F.col("duplicata_de").alias("canonico_md5"), F.col("md5").alias("duplicata_md5")), d, COMPARED),
    }.items()
} | {
    name: over(adapter.pages, f)
    for name, f in {
        "contract_carry": lambda p: P.carry_contracts(p).select("md5", "pagina", "tipo"),
        "return_merge": lambda p: P.merge_returns(p).select("md5", "pagina", "tipo"),
        "holder_by_priority": P.holders,
        "principal_type": P.principal,
        "page_types_ordered": lambda p: P.seen(p).select("md5", F.array_join("tipos", "|").alias("tipos"), F.array_join("dominios", "|").alias("dominios")),
        "first_page_values": lambda p: P.first_values(p, ["cpf", "cnpj"]).withColumn("numeros_cheque", F.array_join("numeros_cheque", "|")),
    }.items()
}


def texts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "postings", sf_dir, lambda: S.stored_order(S.build_index(S.dealt(adapter.texts(spark, sf_dir)), ["texto"])))


def text_search(query: str) -> Query:
    def run(spark, sf_dir):
        postings = texts_index(spark, sf_dir)
        return S.search(postings, S.sizes_of(postings, adapter.texts(spark, sf_dir)), query, 50).withColumn("fts_score", F.round("fts_score", 6))

    return run


QUERIES |= {
    "postings_stats": lambda s, d: texts_index(s, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    "bm25_search": text_search("stupid idiot"),
    "bm25_boolean": text_search("stupid AND idiot NOT trash"),
    "bm25_phrase": text_search('"of the" OR moron'),
    "search_snippets": lambda s, d: S.search_registry(adapter.texts(s, d), texts_index(s, d), S.sizes_of(texts_index(s, d), adapter.texts(s, d)), "stupid OR idiot OR trash", "texto").select("md5", "fts_snippet"),
    "transcript_sanitize": lambda s, d: adapter.texts(s, d).select("md5", P.sanitize_transcript("texto").isNull().alias("descartado")),
    "compare_normalized": lambda s, d: adapter.texts(s, d).select("md5", F.md5(X.normalize_for_compare("texto")).alias("norm")),
    "published_texts": lambda s, d: exported({"textos": adapter.texts(s, d).select("md5", "nome_arquivo", "texto", "lang")})("textos").select("md5", "nome_arquivo", F.md5("texto").alias("texto"), "lang"),
    "exact_duplicates": lambda s, d: D.exact_groups(adapter.texts(s, d), F.md5("texto")),
    "shingle_jaccard_pairs": lambda s, d: D.similar_pairs(D.classes(S.spread(adapter.texts(s, d))), letters=False).select("a", "b", F.round("jaccard", 6).alias("jaccard")),
    "near_duplicate_pairs": lambda s, d: D.refine(D.similar_pairs(D.classes(S.spread(adapter.texts(s, d)))), 0.8),
    "compared_texts": lambda s, d: by_opening(adapter.texts(s, d)).select("a", "b", D.compare("texto_a", "texto_b").alias("similaridade")),
    "near_duplicates_greedy": lambda s, d: D.near_duplicates(S.spread(adapter.texts(s, d))),
    "highlight_counts": lambda s, d: adapter.texts(s, d).select("md5", X.highlight("texto", "the")[1].cast("long").alias("n")),
}


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of rows keyed by user, merged batch by batch: the last state of every user."""
    events = adapter.read(spark, sf_dir, "events")
    root = f"{shared_dir(spark)}/acervo-stream-{uuid.uuid4().hex}"
    table = N.Table(spark, f"{root}/table")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")

    def last(batch: DataFrame) -> DataFrame:
        row = F.struct("ts", "event_id")
        return batch.groupBy(F.md5(F.col("user_id").cast("string")).alias("md5")).agg(F.max_by("event_type", row).alias("status"), F.max_by(F.get_json_object("props", "$.k"), row).alias("k"))

    N.intake(stream, table, last, f"{root}/checkpoint", keep=[]).awaitTermination()
    return table.latest()


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a day as those of a run, arriving in mixed order over several batches: sign-ups say how many files there are, the rest that one is done."""
    root = f"{shared_dir(spark)}/acervo-stream-{uuid.uuid4().hex}"
    k = F.get_json_object("props", "$.k").cast("long")
    event = F.when(F.col("event_type") == "signup", "ready").otherwise("file_done")
    rows = adapter.read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run"), event.alias("event"), "ts", F.col("event_id").alias("number"), (k + 300).alias("total"), k.alias("already"), (F.col("event_type") != "error").alias("ok")
    )
    rows.repartition(6, "number").write.parquet(f"{root}/events")
    table = N.Table(spark, f"{root}/table")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/events")
    G.follow(stream, table, f"{root}/checkpoint").awaitTermination()
    return G.runs(table.latest())


def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the benchmark's first five words, and from frequent words."""
    b = adapter.read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("termo_chave"), F.lit("Prova").alias("valor_atribuido"), F.lit("academico").alias("dominio"), F.col("item_id").alias("id"))
    few = spark.createDataFrame([("the", "Inglês", "outro", 1001), ("und", "Alemão", "outro", 1002), ("idiot", "Ofensa", "outro", 1003)], b.schema)
    return b.unionByName(few)


def common_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every two neighbouring words that at least two documents share."""
    words = S.spread(adapter.texts(spark, sf_dir).select("md5", "texto")).select("md5", F.filter(F.split(F.lower("texto"), r"[ \n\r\t]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 1)
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda w, i: F.concat_ws(" ", w, F.element_at("w", i + 2)))
    shared = words.select("md5", F.explode(F.array_distinct(pairs)).alias("termo_chave")).groupBy("termo_chave").agg(F.count("*").alias("n")).filter("n >= 2 AND length(termo_chave) > 4")
    number = F.conv(F.substring(F.md5("termo_chave"), 1, 15), 16, 10).cast("long")
    return shared.select(number.alias("id"), "termo_chave", F.concat(F.lit("Regra "), F.substring(F.md5("termo_chave"), 1, 2)).alias("valor_atribuido"), F.lit("outro").alias("dominio"))


def odd_extras(df: DataFrame) -> DataFrame:
    """The registry with extra keys that hold dots, brackets and quotes, and values that are objects and lines."""
    odd = F.concat(F.lit(',"a.b":"um\\ndois '), F.substring("md5", 1, 4), F.lit('","c[0]":7,"d \\"e\\"":{"f":[1,true]},"g":null}'))
    return df.withColumn("dados_extras", F.concat(F.regexp_replace("dados_extras", r"\}$", ""), odd))


QUERIES |= {
    "rule_match_many": lambda s, d: K.match_rules(S.spread(adapter.texts(s, d).select("md5", "texto")), kept(s, "rules", d, lambda: common_pairs(s, d))).select("md5", "id", "termo_chave", "valor_atribuido"),
    "html_metadata": lambda s, d: I.html_metadata(adapter.read(s, d, "pages")).drop("meta"),
    "rule_longest_match": lambda s, d: K.match_rules(adapter.texts(s, d), learned_rules(s, d)).select("md5", "id", "valor_atribuido"),
    "text_signatures": lambda s, d: K.classify_documents(S.dealt(adapter.texts(s, d).select("md5", "texto"))).groupBy("tipo", "dominio").agg(F.count("*").alias("documentos")),
    "text_fields": lambda s, d: K.extract_fields(adapter.texts(s, d)).select("md5", "cpf", "cnpj", "valor_monetario", F.size("nomes_detectados").alias("nomes")),
    "document_reports": lambda s, d: O.document_reports(adapter.registry(s, d)),
    "consolidated_report": lambda s, d: O.consolidated_report(adapter.registry(s, d)),
    "flat_table": lambda s, d: O.flat(odd_extras(adapter.registry(s, d)).select("md5", "nome_arquivo", "tipo_documento", "beneficiario", "cpf", "faculdade", "status", "tentativa_ocr_llm", "eh_nativo_digital", "dados_extras")),
    "extras_long": lambda s, d: O.extras(odd_extras(adapter.registry(s, d))),
    "extras_decode": lambda s, d: I.decode_rows(adapter.registry(s, d), ["pix_chave", "emitente"]).select("md5", "pix_chave", "emitente"),
    "dossier_merge": lambda s, d: P.merge_dossier(adapter.registry(s, d), adapter.pages(s, d)).select("md5", "tipo_documento", "dominio"),
    "stream_intake": stream_intake,
    "stream_progress": stream_progress,
}

#: What papers were given at first, by their order key: classes and domains.
TOLD = [("Pagamento_PIX", "financeiro"), ("Comprovante de Residência", "outro"), ("Diploma de Graduação", "academico"), (None, None), ("Carteira de Trabalho", "x"), ("Petição", "veicular"), ("Certidão", ""), ("Cartão CNPJ", "profissional")]


def told(papers: DataFrame) -> DataFrame:
    """Papers with a class and a domain given."""
    g = F.pmod(F.floor(F.col("k") / 12), F.lit(len(TOLD)))
    given = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in TOLD]), g.cast("int") + 1)
    return papers.select("md5", "texto", given(0).alias("tipo_documento"), given(1).alias("dominio"))


def scanned(papers: DataFrame) -> DataFrame:
    """Papers of which a quarter is a picture, read by optical recognition, with ids given to some."""
    picture = F.substring("md5", 2, 1) < "4"
    return papers.select("md5", F.when(~picture, F.col("texto")).alias("texto"), F.when(picture, F.col("texto")).alias("lido"), F.when(F.substring("md5", 1, 1) < "8", F.col("cpf")).otherwise("111.111.111-11").alias("cpf"), F.lit("  ").alias("curso"))


def layered(papers: DataFrame) -> DataFrame:
    """Papers with their text in one of four layers, by their order key, and scraps in the layers before it."""
    at = lambda i, scrap: F.when(F.col("k") % 5 == i, F.concat(F.lit(" "), "texto")).when(F.col("k") % 5 > i, F.lit(scrap))
    loop = "linha de novo\n" * 4
    return papers.select("md5", at(0, "  trinta letras faltam a esta  ").alias("digital"), at(1, "ilegível").alias("ocr"), at(2, loop).alias("transcrito"), at(3, " ").alias("mao"), F.col("nome").alias("emitente"), F.when(F.col("k") % 2 == 0, "serviços").alias("assunto"))


def by_opening(d: DataFrame) -> DataFrame:
    """Pairs (a, b, texto_a, texto_b): every text beside the first of those that begin with the same three words."""
    key = F.array_join(F.slice(F.split(X.normalize_for_compare("texto"), " "), 1, 3), " ")
    texts = d.select("md5", "texto", key.alias("key"))
    first = texts.groupBy("key").agg(F.min("md5").alias("a"))
    named = texts.select(F.col("md5").alias("b"), F.col("texto").alias("texto_b"), "key").join(first.hint("merge"), "key").filter("a != b")
    return named.join(texts.select(F.col("md5").alias("a"), F.col("texto").alias("texto_a")).hint("merge"), "a").select("a", "b", "texto_a", "texto_b")


def bound(papers: DataFrame) -> DataFrame:
    """Papers bound to files of several pages, in the order of their own keys; half of the lists are a contract's last page instead."""
    text = F.when(F.col("k") % 24 == 23, "Fica eleito o foro desta cidade.").otherwise(F.col("texto"))
    return papers.select(F.md5(F.substring("md5", 1, 3)).alias("md5"), F.col("md5").alias("pagina"), text.alias("texto"))


def bound_rules(spark: SparkSession) -> DataFrame:
    """Learned rules for such files: of lists, of diplomas without a domain, and one that must not turn slips into receipts."""
    return spark.createDataFrame([(1, "Listagem de Pagamentos", "Listagem", "financeiro"), (2, "carteira de identidade", "Histórico Escolar", None), (3, "recibo do pagador", "Recibo", "financeiro")], "id long, termo_chave string, valor_atribuido string, dominio string")


QUERIES |= {
    name: over(adapter.forms, f)
    for name, f in {
        "form_signatures": lambda d: K.with_signals(d.select("md5", "texto"), "texto").select("md5", K.signature("texto", True).alias("s")).select("md5", "s.*"),
        "form_documents": lambda d: K.classify_document(told(d)).select("md5", "tipo_documento", "dominio", "pix_e2e_id", "pix_chave", "pix_autenticacao"),
        "form_handwritten": lambda d: d.select("md5", F.array_join(C.with_handwritten(F.when(F.col("k") % 3 == 0, F.array(F.lit("RG"))).when(F.col("k") % 3 == 1, F.array(F.lit("Recibo"), F.lit("Manuscrito"))), C.written_by_hand(F.when(F.col("k") % 7 == 0, "Sim"), F.when(F.col("k") % 5 == 0, "Recibo Manual"), F.when(F.col("modelo") == 7, F.concat("texto", F.lit("De próprio punho"))))), "|").alias("todos_tipos")),
        "form_best_texts": lambda d: layered(d).select("md5", T.best_text(*[F.col(c) for c in ("digital", "ocr", "transcrito", "mao", "emitente", "assunto")]).alias("t")).select("md5", F.md5("t.texto").alias("texto"), "t.origem"),
        "form_pages": lambda d: K.classify_pages(bound(d), bound_rules(d.sparkSession)).select("md5", "pagina", "tipo", "dominio", "cpf", "rg", "cnpj", "curso"),
        "form_page_details": lambda d: P.details(K.classify_pages(bound(d), bound_rules(d.sparkSession))).withColumn("numeros_cheque", F.array_join("numeros_cheque", "|")),
        "form_slips": lambda d: d.select("md5", K.slip("texto").alias("s")).select("md5", "s.*"),
        "form_cheques": lambda d: d.select("md5", K.cheque("texto").alias("s")).filter("s.sim").select("md5", "s.talao", F.array_join("s.numeros", "|").alias("numeros"), "s.banco", "s.serie", "s.conta", "s.agencia"),
        "form_returns": lambda d: d.select("md5", K.tax_return("texto").alias("s")).filter("s.sim").select("md5", "s.recibo", "s.exercicio", "s.ano", "s.numero"),
        "form_incomes": lambda d: d.select("md5", K.income_report("texto").alias("s")).filter("s.sim").select("md5", "s.fonte", "s.ano", "s.cnpj"),
        "form_vehicles": lambda d: d.select("md5", K.vehicle("texto").alias("s")).filter("s.tipo is not null").select("md5", "s.*"),
        "form_contracts": lambda d: d.select("md5", K.sale_contract("texto").alias("s")).filter("s.sim").select("md5", "s.subtipo"),
        "form_notes": lambda d: d.select("md5", K.promissory_note("texto").alias("s")).filter("s.sim").select("md5", "s.numero", "s.valor", "s.vencimento"),
        "form_receipts": lambda d: d.select("md5", K.receipt("texto").alias("s")).filter("s.sim").select("md5", "s.valor"),
        "form_cpf": lambda d: d.select("md5", T.extract_cpf("texto").alias("cpf")),
        "form_cnpj": lambda d: d.select("md5", T.extract_cnpj("texto").alias("cnpj")),
        "form_rg": lambda d: d.select("md5", T.extract_rg("texto").alias("rg")),
        "form_courses": lambda d: d.select("md5", T.extract_course("texto").alias("curso")),
        "form_money": lambda d: d.select("md5", T.extract_money("texto").alias("valor")),
        "form_pix": lambda d: d.select("md5", T.extract_pix_e2e("texto").alias("e2e"), T.extract_pix_key("texto").alias("chave"), T.extract_pix_auth("texto").alias("autenticacao")),
        "form_pix_checked": lambda d: d.select("md5", T.validate_pix("texto", T.extract_pix_e2e("texto"), T.extract_pix_key("texto"), F.lit("Pagamento_PIX")).alias("p")).select("md5", "p.*"),
        "form_company_cards": lambda d: d.filter("texto like 'COMPROVANTE DE INSCR%'").select("md5", T.extract_company_card("texto").alias("c")).select("md5", "c.cnpj", "c.situacao_cadastral", "c.data_abertura", "c.razao_social", "c.telefone", "c.endereco_completo", "c.municipio_uf"),
        "form_names": lambda d: d.select("md5", F.array_join(T.extract_names("texto"), "|").alias("nomes")),
        "form_all_names": lambda d: d.select("md5", F.array_join(T.all_names(F.upper("nome"), F.array("nome", F.lit("Zeca Dias")), "texto"), "|").alias("nomes")),
        "form_fields": lambda d: K.extract_fields(scanned(d), ocr_col="lido").select("md5", "cpf", "cnpj", "rg", "curso", "valor_monetario", "pix_e2e_id", F.array_join("nomes_detectados", "|").alias("nomes_detectados")),
    }.items()
}


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_rules(spark, sf_dir).withColumn("campo_alvo", F.lit("tipo_documento"))


def by_term(postings: DataFrame) -> DataFrame:
    """Documents and occurrences of every term; postings that lie together by md5 are not dealt out again."""
    return postings.groupBy("md5", "term").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapter.texts(spark, sf_dir)
    changed = docs.filter("doc_id % 3 = 0").select("md5", F.concat(F.lit("termo inédito "), F.coalesce("texto", F.lit(""))).alias("texto"))
    return S.update_index(texts_index(spark, sf_dir), changed, ["texto"]).transform(by_term)


def segmented_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents streamed into an index in batches, compacted, then a third of them again with another text."""
    docs = adapter.texts(spark, sf_dir).select("md5", "doc_id", "texto")
    root = f"{shared_dir(spark)}/acervo-segments-{uuid.uuid4().hex}"
    index = Segments(spark, f"{root}/index")
    again = docs.filter("doc_id % 3 = 0").withColumn("texto", F.concat(F.lit("termo inédito "), F.coalesce("texto", F.lit(""))))
    for part, compacted in ((docs.repartition(3, "md5"), True), (again.repartition(2, "md5"), False)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        index_stream(stream, index, ["texto"], f"{root}/checkpoint").awaitTermination()
        if compacted:
            index.compact()
            index.vacuum()
    return by_term(index.postings())


def page_changes(pages: DataFrame) -> DataFrame:
    """The first page of documents whose lines came back, and a page of documents that have none."""
    return pages.filter("tipo = 'RG' and pagina <= 2").select("md5", "pagina", F.lit("Diploma").alias("tipo"))


def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = adapter.passed(spark, sf_dir).select("md5", "tipo_documento", "dominio")
    pages = written(adapter.passed_pages(spark, sf_dir).select("md5", "pagina", "tipo"), "pages")  # read twice below
    known = pages.filter("substring(md5, 1, 1) < '8'")  # the others' lists are still empty
    out = R.reclassify(registry, known, page_changes(pages))
    shown = F.array_join(F.transform("dossie_paginas", lambda p: F.concat_ws("=", p["pagina"].cast("string"), p["tipo"])), "|")
    return out.select("md5", "tipo_documento", shown.alias("paginas"), F.array_join("todos_tipos", "|").alias("tipos"))


def marked() -> Column:
    """The turns of a conversation as one text with page marks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("--- PÁGINA "), x["turn"].cast("string"), F.lit(" ---\n"), F.coalesce(x["text"], F.lit("")))), "\n")


def lines() -> Column:
    return F.transform(F.split(F.coalesce("texto", F.lit("")), "\n"), lambda x: F.trim(x))


QUERIES |= {
    name: over(adapter.registry, f)
    for name, f in {
        "everything": lambda d: L.everything(d, True).select("md5", "status"),
        "recalculated_domains": lambda d: L.with_types(d).select("md5", F.array_join(C.recalculated_domains("dominio", "todos_tipos"), "|").alias("dominios")),
        "listified": lambda d: L.listify(L.with_types(d).select("md5", "todos_tipos")),
        "restricted": lambda d: R.restrict(d, d.filter("tipo_documento = 'RG'").select(F.coalesce("duplicata_de", "md5").alias("md5"))).select("md5", "tipo_documento"),
        "flags_updated": lambda d: R.set_flags(d, d.filter("tipo_documento = 'RG'").select("md5", (~F.col("eh_nativo_digital")).alias("eh_nativo_digital"), F.lit(None).cast("boolean").alias("tem_assinatura_digital"))).select("md5", "eh_nativo_digital", "tem_assinatura_digital"),
        "duplicates_marked": lambda d: R.mark_duplicates(d, d.filter("tipo_documento = 'CPF'").select(F.md5("md5").alias("canonico_md5"), F.col("md5").alias("duplicata_md5"), F.lit(0.95).alias("similaridade"))).select("md5", "duplicata_de"),
        "duplicates_confirmed": lambda d: R.resolve_duplicates(d, d.filter("duplicata_de is not null"), True).select("md5", "status_conferencia", "duplicata_de"),
        "duplicates_discarded": lambda d: R.resolve_duplicates(d, d.filter("duplicata_de is not null and eh_nativo_digital"), False).select("md5", "status_conferencia", "duplicata_de"),
        "primary_type_set": lambda d: R.set_primary_type(d, d.filter("tipo_documento = 'RG'"), "Boleto Bancário").select("md5", "tipo_documento", "dominio"),
        "file_attrs_filled": lambda d: R.fill_file_attrs(d, d.select("md5", F.concat(F.lit("novo_"), "nome_arquivo").alias("nome_arquivo"), F.lit(".bin").alias("extensao"))).select("md5", "nome_arquivo", "extensao"),
        "approved_type": lambda d: R.save_reviewed(d.select("md5", "tipo_documento", "status_conferencia"), d.sparkSession.createDataFrame([], "id long, termo_chave string, campo_alvo string, valor_atribuido string, dominio string, remover_pix boolean, origem_md5 string"), d.filter("tipo_documento = 'RG'").select("md5", F.lit("CNH").alias("tipo_documento"), F.lit("pendente").alias("status_conferencia")), d.select("md5", F.col("tipo_documento").alias("tipo"), F.lit("").alias("texto")), "2024")[0],
    }.items()
} | {
    "rules_upserted": lambda s, d: R.upsert_rules(taught(s, d), taught(s, d).select(F.when(F.col("id") % 2 == 0, F.col("termo_chave")).otherwise(F.concat("termo_chave", F.lit(" novo"))).alias("termo_chave"), "campo_alvo", F.lit("Outro").alias("valor_atribuido"), "dominio")).select("id", F.lower("termo_chave").alias("termo_chave"), "valor_atribuido"),
    "rules_newest_first": lambda s, d: K.newest_first(R.delete_rule(taught(s, d), 1002)).select("id", "termo_chave"),
    "rules_learned": lambda s, d: K.learn_rules(written(K.with_signals(adapter.forms(s, d).select("md5", "texto"), "texto").select("md5", K.signature("texto", True)["tipo"].alias("tipo"), "texto"), "typed")).filter("termo_chave in ('diploma', 'recibo', 'nota promissória', 'confere o grau', 'recebi de')").select("termo_chave", "valor_atribuido", "dominio", "remover_pix"),
    "index_updated": updated_index,
    "index_segments": segmented_index,
    "pages_reclassified": reclassified,
    "pages_split": lambda s, d: P.split_pages(adapter.read(s, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("md5")).agg(marked().alias("texto"))).select("md5", F.col("pagina").cast("long").alias("pagina"), F.md5("texto").alias("texto")),
    "line_runs": lambda s, d: adapter.texts(s, d).select("md5", P.longest_run(lines()).cast("long").alias("linhas")),
    "comparison_texts": lambda s, d: adapter.texts(s, d).withColumns({"a": F.when(F.col("doc_id") % 3 == 0, F.col("texto")).otherwise("  "), "b": F.when(F.col("doc_id") % 3 == 1, F.col("texto"))}).select("md5", F.md5(D.comparison_text("a", "b", "nome_arquivo")).alias("texto")),
}
