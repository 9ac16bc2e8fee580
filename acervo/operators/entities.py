"""Dossiers per person or company, and the relational export (ENT-1..7, JOI-7, SRT-4, SNK-5, SNK-8, SNK-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import text as X
from acervo.operators.filters import extra
from acervo.sources.publish import publish
from acervo.sources.tables import written


def norm(name: Column | str) -> Column:
    """Upper case without diacritics, spaces collapsed."""
    return F.upper(F.trim(F.regexp_replace(X.strip_marks(F.coalesce(X.col(name), F.lit(""))), r"\s+", " ")))


def dossier_key() -> Column:
    """ENT-1: (tipo, identificador) by cpf, else cnpj, else a holder of two words and eight letters."""
    name = F.trim("beneficiario")
    full = (F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) >= 2) & (F.length(name) >= 8)
    key = lambda k, v: F.struct(F.lit(k).alias("tipo_entidade"), v.alias("identificador"))
    cpf, cnpj = X.format_id("cpf"), X.format_id("cnpj")
    return F.when(cpf.isNotNull(), key("CPF", cpf)).when(cnpj.isNotNull(), key("CNPJ", cnpj)).when(full, key("NOME", F.regexp_replace(F.upper(name), r"\s+", " ")))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", dossier_key()).filter("_k is not null").withColumns({"tipo_entidade": F.col("_k.tipo_entidade"), "identificador": F.col("_k.identificador")}).drop("_k")


def dossiers(df: DataFrame) -> DataFrame:
    """ENT-2, WIN-8: groups of two documents or more, with the first holder named and the identifier as a fallback."""
    slug = F.concat(F.lit("dossie_"), F.regexp_replace(F.lower(F.concat_ws("_", "tipo_entidade", "identificador")), "[^a-z0-9_]", "_"))
    by = _keyed(df).groupBy("tipo_entidade", "identificador").agg(F.min_by(X.nonblank("beneficiario"), F.when(X.present("beneficiario"), F.col("md5"))).alias("nome"), F.count("*").alias("total_documentos"))
    return by.filter("total_documentos >= 2").select(slug.alias("id"), "tipo_entidade", "identificador", F.coalesce("nome", "identificador").alias("nome_titular"), "total_documentos")


def assign(df: DataFrame) -> DataFrame:
    """ENT-2: the registry with dossie_id, null where there is no dossier."""
    of = _keyed(df.drop("dossie_id")).join(dossiers(df).select("tipo_entidade", "identificador", F.col("id").alias("dossie_id")), ["tipo_entidade", "identificador"]).select("md5", "dossie_id")
    return df.drop("dossie_id").join(of, "md5", "left")


def dossier_documents(df: DataFrame) -> DataFrame:
    """ENT-3, JOI-7: dossiers with their documents ordered by date and file name, largest first."""
    rows = assign(df).filter(F.col("dossie_id").isNotNull()).groupBy(F.col("dossie_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("data", F.lit("")).alias("d"), "nome_arquivo", "md5"))), lambda x: x["md5"]).alias("documentos"))
    return dossiers(df).join(rows, "id").orderBy(F.desc("total_documentos"), "nome_titular", "id")


def _sha(text: Column, size: int) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, size)


def party() -> Column:
    """ENT-4, ENT-5: the row of a person or a company, of prepared columns (pj, n, d, r, code, valid).

    A valid cpf or cnpj, or a person's name and rg, merge documents; a name alone never does.
    """
    none, n, d = F.lit(""), F.col("n"), F.col("d")
    row = lambda i, cpf, rg, cnpj, open_, kind: F.struct(i.alias("id"), n.alias("nome"), cpf.alias("cpf"), rg.alias("rg"), cnpj.alias("cnpj"), F.lit(open_).alias("incompleta"), F.lit(kind).alias("tipo"))
    alone = lambda kind: F.concat(F.lit(f"{kind}_PROV_"), F.substring("md5", 1, 16), F.lit("_"), _sha(n, 8))
    firm = F.when(F.col("valid"), row(F.concat(F.lit("PJ_"), d), none, none, d, False, "PJ")).otherwise(row(alone("PJ"), none, none, none, True, "PJ"))
    human = F.when(F.col("valid"), row(F.concat(F.lit("PF_"), d), d, F.col("r"), none, False, "PF")).when(F.col("r") != "", row(F.concat(F.lit("PF_RGNM_"), _sha(F.concat(n, F.lit("|"), F.col("code")), 16)), none, F.col("code"), none, False, "PF"))
    human = human.otherwise(row(alone("PF"), none, none, none, True, "PF"))
    return F.when(F.col("pj"), firm).otherwise(human)


def roles(df: DataFrame, kind: str | None = None) -> DataFrame:
    """ENT-6: one row per party (of one kind, PF or PJ) of a document: md5, pos, papel and the party's fields.

    Parties are taken apart as they stand, and each is then put into form once.  The kind is
    asked before that: a filter behind it would write the whole form out again.
    """
    none = F.lit(None).cast("string")
    field = lambda c: F.col(c) if c in df.columns else none
    raw = lambda pos, papel, yes, name, number=none, rg=none, pj=F.lit(False): F.when(yes, F.struct(F.lit(pos).alias("pos"), F.lit(papel).alias("papel"), name.alias("nome"), number.alias("numero"), rg.alias("rg"), pj.alias("pj")))
    holder, payer = X.present("beneficiario"), field("fonte_pagadora")
    own = F.coalesce(raw(0, "titular", holder, F.col("beneficiario"), F.col("cpf"), F.col("rg")), raw(0, "titular", X.present(field("razao_social")), field("razao_social"), F.col("cnpj"), none, F.lit(True)))
    firm = F.coalesce(X.valid_cnpj(field("cnpj_fonte_pagadora")), F.lit(False))
    paid = raw(1, "fonte_pagadora", X.present(payer), payer, F.when(firm, field("cnpj_fonte_pagadora")), none, firm)
    simple = [("emitente", F.coalesce(field("emitente"), extra("emitente"))), ("vendedor", field("vendedor")), ("comprador", field("comprador")), ("proprietario_anterior", field("proprietario_anterior"))]
    listed = F.transform(F.filter(F.coalesce(F.from_json(extra("nomes_detectados"), "array<string>"), F.array().cast("array<string>")), lambda x: X.present(x)), lambda x: raw(9, "listado", F.lit(True), x))
    every = F.concat(F.array(own, paid, *[raw(2 + i, p, X.present(v), v) for i, (p, v) in enumerate(simple)]), listed)
    parties = df.select("md5", "beneficiario", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("md5", "beneficiario", "x.*")
    parties = parties.filter((F.col("papel") != "listado") | (norm("nome") != norm("beneficiario")))
    parties = parties if kind is None else parties.filter(F.col("pj") if kind == "PJ" else ~F.col("pj"))
    # in steps, so that no expression is written out more than once
    ready = parties.select("md5", "pos", "papel", "pj", norm("nome").alias("n"), X.digits("numero").alias("d"), F.trim(F.coalesce("rg", F.lit(""))).alias("r"), X.digits("rg").alias("rd"))
    ready = ready.select("*", F.coalesce(F.nullif("rd", F.lit("")), F.upper("r")).alias("code"), F.when(F.col("pj"), X.valid_cnpj("d")).otherwise(X.valid_cpf("d")).alias("valid"))
    return ready.select("md5", "pos", "papel", party().alias("e")).select("md5", "pos", "papel", "e.*")


def links(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """made, here and below: the rows of roles(), where they are there already."""
    return (roles(df) if made is None else made).select(F.col("md5").alias("documento_md5"), F.col("id").alias("entidade_id"), F.col("tipo").alias("tipo_entidade"), "papel")


def _entities(df: DataFrame, kind: str, made: DataFrame | None = None) -> DataFrame:
    """ENT-7: one row per entity: the fields of its first document, and its documents."""
    first = F.min_by(F.struct("nome", "cpf", "rg", "cnpj", "incompleta"), F.struct("md5", "pos"))
    rows = roles(df, kind) if made is None else made.filter(F.col("tipo") == kind)
    return rows.groupBy(F.col("id").alias("entidade_id")).agg(first.alias("f"), F.array_sort(F.collect_set("md5")).alias("documentos_md5"))


def people(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    return _entities(df, "PF", made).select("entidade_id", F.col("f.nome").alias("nome_normalizado"), "f.cpf", "f.rg", F.col("f.incompleta").alias("identificacao_incompleta"), "documentos_md5")


def companies(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    return _entities(df, "PJ", made).select("entidade_id", F.col("f.nome").alias("razao_social_normalizada"), "f.cnpj", F.col("f.incompleta").alias("identificacao_incompleta"), "documentos_md5")


def _holders(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    return (roles(df) if made is None else made).filter("papel = 'titular'").select("md5", F.col("id").alias("entidade_titular_id"), F.col("tipo").alias("tipo_entidade"))


def addresses(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """One row per document with an address and a holder."""
    return df.filter(X.present("endereco_completo")).join(_holders(df, made).hint("merge"), "md5").select(F.col("entidade_titular_id").alias("entidade_id"), "tipo_entidade", F.col("md5").alias("documento_md5"), F.trim("endereco_completo").alias("endereco_completo"))


def document_rows(df: DataFrame, made: DataFrame | None = None) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.join(_holders(df, made).hint("merge"), "md5", "left").select("md5", *[blank(c) for c in ("nome_arquivo", "tipo_documento", "data", "entidade_titular_id", "status", "status_conferencia")])


def relational(df: DataFrame) -> dict[str, DataFrame]:
    """SNK-5: the five tables of people, companies, addresses, documents and links, all of the same parties, which are taken apart once."""
    made = written(roles(df), "roles")
    return {"pessoas_fisicas": people(df, made), "pessoas_juridicas": companies(df, made), "enderecos": addresses(df, made), "documentos": document_rows(df, made), "vinculos": links(df, made)}


def export(df: DataFrame, path: str) -> str:
    """SNK-5: the five tables as CSV folders under a new version of path, published when whole."""
    return publish(relational(df), path)


def organize(df: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-8: (md5, nome_arquivo, origem, destino, classe, estado) of every document, by the files (caminho, relative) that exist.

    A document's file stands at its relative path, else under its name; without either its
    estado is "ausente" and it has neither origem nor destino.
    """
    there = files.select(F.col("caminho").alias("origem")).distinct()
    relative = F.coalesce(X.nonblank("caminho_relativo"), F.col("nome_arquivo")) if "caminho_relativo" in df.columns else F.col("nome_arquivo")
    asked = df.withColumn("classe", F.coalesce(X.nonblank("tipo_documento"), F.lit("Geral"))).select("md5", "classe", relative.alias("_p"), F.col("nome_arquivo").alias("_n"))
    by = lambda c: there.select(F.col("origem").alias(c), F.col("origem").alias(f"{c}_da"))
    found = asked.join(by("_p").hint("merge"), "_p", "left").join(by("_n").hint("merge"), "_n", "left").select("md5", "classe", F.coalesce("_p_da", "_n_da").alias("origem"))
    whole = organize_plan(df).join(found.hint("merge"), "md5")
    state = F.when(F.col("origem").isNull(), "ausente").otherwise("planejado")
    return whole.select("md5", "nome_arquivo", "origem", F.when(F.col("origem").isNotNull(), F.col("destino")).alias("destino"), "classe", state.alias("estado"))


def organize_plan(df: DataFrame) -> DataFrame:
    """SNK-8: where every document would go: class, year, and a name of date, class, holder, value and md5."""
    part = X.sanitize_part
    value = F.when(X.parse_money("valor_monetario") > 0, part(F.replace("valor_monetario", F.lit("R$ "), F.lit("R$")), "", 20))
    year = F.coalesce(X.extract_year("data").cast("string"), F.lit("Sem_Ano"))
    name = F.concat_ws("_", part(F.replace("data", F.lit("/"), F.lit("-")), "Sem_Data", 20), part("tipo_documento"), part(F.coalesce(X.nonblank("beneficiario"), "faculdade")), value, F.substring("md5", 1, 8))
    ext = F.coalesce("extensao", F.lower(F.nullif(F.regexp_extract("nome_arquivo", r"(\.[^./]+)$", 1), F.lit(""))), F.lit(""))
    return df.select("md5", "nome_arquivo", F.concat(F.concat_ws("/", part("tipo_documento"), year, name), ext).alias("destino"))


def archive_names(df: DataFrame, name_col: str = "nome_arquivo") -> DataFrame:
    """SNK-9: unique member names; the first of a name keeps it, later ones get part of their md5 and a number."""
    n = F.row_number().over(Window.partitionBy(name_col).orderBy("md5"))
    stem, suffix = F.regexp_replace(name_col, r"\.[^./]+$", ""), F.regexp_extract(name_col, r"(\.[^./]+)$", 1)
    return df.select("md5", name_col, n.alias("_n")).select("md5", F.when(F.col("_n") == 1, F.col(name_col)).otherwise(F.concat(stem, F.lit("_"), F.substring("md5", 1, 6), F.lit("_"), (F.col("_n") - 1).cast("string"), suffix)).alias("membro"))
