"""Predicates, facets and search filters over the registry (FIL-1..19, SRT, SET-2, SET-5, AGG-23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import classes as C
from acervo.functions import text as X
from acervo.sources.tables import written

UNTYPED = "Não identificado"
#: Class names that say nothing (fixed values).
EMPTY_TYPES = ["", "documento", "não identificado"]


def listed(text: Column | str) -> Column:
    """A JSON list or a comma list as an array of trimmed, non-empty texts (SRC-8)."""
    t = F.coalesce(X.col(text), F.lit(""))
    items = F.coalesce(F.when(F.trim(t).startswith("["), F.from_json(t, "array<string>")), F.split(t, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def distinct_folded(items: Column) -> Column:
    """First of each spelling, case aside, in order."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def type_set(main: Column | str, types: Column | str, pages: Column | None = None) -> Column:
    """FIL-10, SET-2: main class, then listed ones, then page classes; without any, one 'Não identificado'."""
    every = F.concat(F.array(F.coalesce(X.col(main), F.lit(""))), F.coalesce(X.col(types), F.array().cast("array<string>")), pages if pages is not None else F.array().cast("array<string>"))
    kept = distinct_folded(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(EMPTY_TYPES)))
    return F.when(F.size(kept) == 0, F.array(F.lit(UNTYPED))).otherwise(kept)


def with_types(df: DataFrame) -> DataFrame:
    return df.withColumn("todos_tipos", type_set("tipo_documento", listed("todos_tipos_texto")))


def get(df: DataFrame, md5: str) -> DataFrame:
    """FIL-1."""
    return df.filter(F.col("md5") == md5.strip().lower())


def everything(df: DataFrame, only_processed: bool = False) -> DataFrame:
    """FIL-2: ordered by md5."""
    return (df.filter(F.coalesce(F.col("status"), F.lit("")) != "nao_processado") if only_processed else df).orderBy("md5")


def extra(key: str) -> Column:
    return F.get_json_object("dados_extras", f"$.{key}")


def is_unprocessed() -> Column:
    """FIL-3."""
    domain = F.lower(F.coalesce("dominio", F.lit("academico")))
    waiting = (F.col("status") == "nao_processado") | (F.lower("status_conferencia") == "nao_processado") | (X.present("status") & (F.col("status") != "sucesso"))
    paid = X.present("valor_monetario") | X.present("beneficiario") | reduce(lambda a, b: a | b, (X.present(extra(k)) for k in ("pix_pagador_nome", "pix_e2e_id", "pix_chave")))
    lacking = F.when(domain == "financeiro", ~paid).when(domain != "academico", X.blank("beneficiario") & X.blank("tipo_documento")).otherwise(X.blank("beneficiario") & X.blank("curso"))
    return F.coalesce(waiting, F.lit(False)) | lacking


def review_bucket() -> Column:
    """FIL-4."""
    return F.when(is_unprocessed(), "nao_processado").when(F.lower(F.coalesce("status_conferencia", F.lit("pendente"))) == "aprovado", "aprovado").otherwise("pendente")


def review_buckets(df: DataFrame) -> DataFrame:
    """FIL-4 as counts, and how many rows of each bucket have several classes."""
    many = F.size(listed("todos_tipos_texto")) >= 2
    return df.groupBy(review_bucket().alias("situacao")).agg(F.count("*").alias("documentos"), F.count_if(many).alias("dossies"))


SEARCHED = ["nome_arquivo", "tipo_documento", "beneficiario", "cpf", "rg", "cnpj", "curso", "natureza_curso", "faculdade", "valor_monetario", "data", "dominio", "status", "dados_extras"]


def token_search(df: DataFrame, query: str, columns: list[str] = SEARCHED) -> DataFrame:
    """FIL-5: every word of the query is in the folded row, or its digits (two or more) are in an id."""
    import unicodedata

    words = ["".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn") for w in query.split()]
    blob = X.fold(F.concat_ws(" ", *[c for c in columns if c in df.columns]))
    ids = F.concat_ws(" ", *[X.digits(c) for c in ("cpf", "rg", "cnpj")])
    tests = [blob.contains(w) | (ids.contains(n) if len(n := "".join(c for c in w if c.isdigit())) >= 2 else F.lit(False)) for w in words]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def domain_filter(domain: str) -> Column:
    """FIL-7: main or any listed domain; 'outros' is anything but academico and financeiro."""
    main = F.lower(F.coalesce("dominio", F.lit("academico")))
    every = C.recalculated_domains("dominio", "todos_tipos")
    if domain == "outros":
        return F.exists(F.array_append(every, main), lambda d: ~d.isin("academico", "financeiro"))
    return (main == domain) | F.array_contains(every, domain)


def facets() -> dict[str, Column]:
    """The values a row has in every facet, as arrays."""
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return {
        "instituicao": one(X.normalize_institution("faculdade")),
        "natureza": one(X.academic_level("natureza_curso")),
        "tipo": F.col("todos_tipos"),
        "macro": F.filter(F.array(*[F.when(C.macro_tag(t, "todos_tipos", "dominio", "cnpj"), F.lit(t)) for t in C.MACROS]), lambda x: x.isNotNull()),
        "dominio": C.recalculated_domains("dominio", "todos_tipos"),
        "status": one(review_bucket()),
        "formato": one(C.format_class("extensao", "nome_arquivo")),
    }


def passes(values: dict[str, Column], selections: dict[str, list[str]], exclude: str | None = None) -> Column:
    """FIL-6: any of the selected values in each facet, all facets together; one facet may be left out."""
    tests = [F.arrays_overlap(values[f], F.array(*[F.lit(v) for v in chosen])) for f, chosen in selections.items() if chosen and f != exclude]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def facet_filter(df: DataFrame, selections: dict[str, list[str]], exclude: str | None = None) -> DataFrame:
    return with_types(df).filter(passes(facets(), selections, exclude))


def facet_counts(df: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """AGG-23: documents per facet value under all the other facets' filters; selected values stay with 0.

    One scan: rows that agree in what the facets are made of are counted first, so the
    cascades run once for each kind of row; the kinds are written, as their values serve every facet.
    """
    values = facets()
    made_of = ["faculdade", "natureza_curso", "todos_tipos", "dominio", "cnpj"]
    row = with_types(df).withColumns({"cnpj": F.when(X.present("cnpj"), F.lit("x")), "_status": values["status"], "_formato": values["formato"]})
    kinds = row.groupBy(*made_of, "_status", "_formato").agg(F.count("*").alias("n"))
    done = {"status": F.col("_status"), "formato": F.col("_formato")}
    rows = written(kinds.select("n", *[done.get(f, v).alias(f) for f, v in values.items()]), "facets")
    own = {f: F.col(f) for f in values}

    def stack(facet: str) -> Column:
        ok = passes(own, selections, facet)
        return F.transform(F.array_distinct(facet), lambda v: F.struct(F.lit(facet).alias("faceta"), v.alias("valor"), F.when(ok, F.col("n")).otherwise(0).alias("n")))

    stacked = F.flatten(F.array(*[stack(f) for f in values]))
    counted = rows.select(F.explode(stacked).alias("x")).groupBy("x.faceta", "x.valor").agg(F.sum("x.n").alias("documentos"))
    chosen = df.sparkSession.createDataFrame([(f, v) for f, vs in selections.items() for v in vs] or [("", "")], "faceta string, valor string")
    kept = counted.join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), ["faceta", "valor"], "left").filter("documentos > 0 or chosen").drop("chosen")
    missing = F.broadcast(chosen.filter("faceta != ''")).join(counted.select("faceta", "valor"), ["faceta", "valor"], "left_anti").withColumn("documentos", F.lit(0).cast("long"))
    return kept.unionByName(missing).orderBy("faceta", F.desc("documentos"), "valor")


#: FIL-8: named selections.
VIEWS = {
    "todos": {}, "dossies": {}, "pendentes": {"status": ["pendente"]}, "cursos": {"dominio": ["academico"]}, "financeiro": {"dominio": ["financeiro"]},
    "identificacao": {"dominio": ["identificacao"]}, "nao_processado": {"status": ["nao_processado"]},
}


def quick_view(df: DataFrame, name: str) -> DataFrame:
    """FIL-8."""
    out = facet_filter(df, VIEWS[name])
    return out.filter(F.size("todos_tipos") >= 2) if name == "dossies" else out


def subtags() -> Column:
    """FIL-13: labels of a row that depend on its domain."""
    city = F.nullif(F.regexp_extract(F.coalesce("endereco_completo", F.lit("")), r"([\p{L} ]+)/([A-Z]{2})\b", 0), F.lit(""))
    value, holder = X.nonblank("valor_monetario"), X.nonblank("beneficiario")
    d = F.coalesce("dominio", F.lit("academico"))
    tags = F.when(d == "financeiro", F.array(value, extra("numero_cheque"), extra("banco_cheque"), extra("pix_chave"))).when(d == "veicular", F.array(extra("placa"), extra("renavam"), extra("chassi"))).when(d == "profissional", F.array(X.format_cnpj("cnpj"), extra("situacao_cadastral"), city)).when(d == "identificacao", F.array(X.format_cpf("cpf"), X.nonblank("rg"))).when(d == "juridico", F.array(holder, X.nonblank("vendedor"))).otherwise(F.array(X.nonblank("curso"), X.normalize_institution("faculdade")))
    return F.filter(tags, lambda t: t.isNotNull())


def escalation_reason(text_length: Column | None = None) -> Column:
    """FIL-15: why a row needs a second reading; null if it does not.  The first reason counts."""
    kind, domain = F.trim(F.coalesce("tipo_documento", F.lit(""))), F.lower(F.trim(F.coalesce("dominio", F.lit(""))))
    low, lacks = F.lower(kind), X.blank
    hand = C.is_handwritten("tipo_documento", "todos_tipos")
    academic = (domain == "academico") | X.any_of(low, "diploma certificado histórico historico declaração declaracao".split())
    financial = (domain == "financeiro") | X.any_of(low, ["comprovante", "pagamento", "recibo", "nota fiscal", "extrato"])
    n = F.coalesce(text_length, F.lit(0)) if text_length is not None else F.lit(0)
    short = (n > 0) & (n < 100)
    reasons = [
        (F.col("status") == "erro", F.concat(F.lit("falha_leitura_local ("), F.coalesce(X.nonblank("erro"), F.lit("erro_leitura")), F.lit(")"))),
        (F.upper(kind).isin("", "NÃO IDENTIFICADO", "NAO IDENTIFICADO", "OUTRO", "DESCONHECIDO", "DOCUMENTO NÃO IDENTIFICADO"), F.lit("tipo_documento_inconclusivo")),
        (hand & lacks("beneficiario") & lacks("valor_monetario") & lacks("curso") & lacks(extra("emitente")), F.lit("manuscrito_incompleto")),
        (academic & lacks("beneficiario"), F.lit("beneficiario_ausente")),
        (academic & lacks("curso") & lacks("faculdade"), F.lit("dados_academicos_essenciais_ausentes")),
        (~academic & financial & lacks("valor_monetario") & lacks("beneficiario"), F.lit("dados_financeiros_essenciais_ausentes")),
        (short & F.when(domain == "academico", lacks("beneficiario") | lacks("curso")).otherwise(lacks("beneficiario") & lacks("valor_monetario")), F.lit("camada_textual_insuficiente")),
    ]
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), why) for test, why in reasons])


#: Fields of which one is enough for success.
USEFUL = ["tipo_documento", "beneficiario", "cpf", "rg", "cnpj", "curso", "faculdade", "valor_monetario", "data", "carga_horaria", "natureza_curso"]
USEFUL_EXTRAS = ["texto_transcrito", "razao_social", "linha_digitavel", "numero_cheque", "placa"]


def final_status() -> tuple[Column, Column]:
    """FIL-16: (status, message)."""
    useful = F.coalesce(*[X.nonblank(c) for c in USEFUL], *[X.nonblank(extra(k)) for k in USEFUL_EXTRAS]).isNotNull()
    return F.when(useful, "sucesso").otherwise("erro"), F.when(~useful, "Nenhum dado útil extraído")


def bi_scope(df: DataFrame, scope: str = "all", domain: str | None = None) -> DataFrame:
    """FIL-17: all, classified (success and typed) or approved rows, of one domain if given."""
    if scope == "classified":
        df = df.filter((F.col("status") == "sucesso") & X.present("tipo_documento"))
    elif scope == "approved":
        df = df.filter(F.lower("status_conferencia") == "aprovado")
    return df if domain is None else df.filter(F.lower(F.coalesce("dominio", F.lit("outro"))) == domain)


def listify(df: DataFrame) -> DataFrame:
    """FIL-18: array columns of texts joined by ', '."""
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<string>"]
    return df.withColumns({c: F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), ", ") for c in arrays})


ACTIVE = ["dominio", "tipo_documento", "beneficiario", "cpf", "rg", "cnpj", "curso", "natureza_curso", "carga_horaria", "faculdade", "valor_monetario", "data", "endereco_completo", "fonte_pagadora", "vendedor", "razao_social"]
NULL_LIKE = ["", "null", "none", "n/a", "-", "não informado", "nao informado", "undefined"]


def active_fields(df: DataFrame, columns: list[str] = ACTIVE) -> DataFrame:
    """FIL-19: (md5, chave, valor) of the filled fields, then of scalar extras whose key is not a field."""
    own = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    more = F.map_filter(F.coalesce(F.from_json("dados_extras", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(columns) & ~F.coalesce(v, F.lit("")).rlike(r"^[\[{]"))
    return df.select("md5", F.explode(F.map_concat(own, more)).alias("chave", "valor")).filter(~F.lower(F.trim(F.coalesce("valor", F.lit("")))).isin(NULL_LIKE))


def gallery(df: DataFrame, order: str = "data_desc", offset: int = 0, size: int | None = None) -> DataFrame:
    """SRT-1, SRT-2: the gallery's orders with md5 as the last key, and a page of them."""
    day = F.coalesce(X.nonblank("data"), F.col("data_modificacao"), F.lit(""))
    name = X.fold(F.coalesce(X.nonblank("beneficiario"), F.col("nome_arquivo")))
    rank = F.when(review_bucket() == "pendente", 0).when(review_bucket() == "nao_processado", 1).otherwise(2)
    keys = {"data_asc": [day.asc()], "data_desc": [day.desc()], "nome_asc": [name.asc()], "nome_desc": [name.desc()], "instituicao": [X.fold("faculdade").asc()], "pendentes": [rank.asc()], "paginas": [F.size(listed("todos_tipos_texto")).desc()]}
    out = df.orderBy(*keys[order], "md5")
    out = out.offset(offset) if offset else out
    return out if size is None else out.limit(size)


def master_values(df: DataFrame) -> DataFrame:
    """SET-5: distinct natures, institutions and classes as (lista, valor)."""
    one = lambda n, v: F.transform(v, lambda x: F.struct(F.lit(n).alias("lista"), x.alias("valor")))
    every = F.concat(one("natureza", F.array(X.nonblank("natureza_curso"))), one("instituicao", F.array(X.nonblank("faculdade"))), one("tipo", F.col("todos_tipos")))
    return with_types(df).select(F.explode(every).alias("x")).select("x.*").filter("valor is not null").distinct().orderBy("lista", "valor")
