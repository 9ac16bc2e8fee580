"""Reports and files out of the registry (SNK-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import text as X
from acervo.operators.filters import NULL_LIKE
from acervo.sources.tables import written

FINANCIAL = [("Valor", "valor_monetario"), ("Data", "data"), ("Pagador", "fonte_pagadora"), ("Titular", "beneficiario"), ("CPF", "cpf"), ("CNPJ", "cnpj")]
ACADEMIC = [("Titular", "beneficiario"), ("CPF", "cpf"), ("Curso", "curso"), ("Natureza", "natureza_curso"), ("Carga horária", "carga_horaria"), ("Instituição", "faculdade"), ("Data", "data")]
GENERAL = [("Titular", "beneficiario"), ("CPF", "cpf"), ("RG", "rg"), ("CNPJ", "cnpj"), ("Data", "data"), ("Endereço", "endereco_completo")]


def write_registry_json(df: DataFrame, path: str, only_processed: bool = True) -> None:
    """SNK-1: rows in md5 order; the commit protocol makes the replacement whole."""
    rows = df.filter(F.coalesce(F.col("status"), F.lit("")) != "nao_processado") if only_processed else df
    rows.orderBy("md5").write.mode("overwrite").json(path)


def _lines(df: DataFrame, fields: list[tuple[str, str]]) -> Column:
    rows = [F.when(~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(NULL_LIKE), F.concat(F.rpad(F.lit(label + ":"), 18, " "), F.trim(c))) for label, c in fields if c in df.columns]
    return F.array_join(F.filter(F.array(*rows), lambda x: x.isNotNull()), "\n")


def document_reports(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """SNK-2: (md5, relatorio): only fields that say something, by the row's domain, then the full text."""
    body = F.when(F.col("dominio") == "financeiro", _lines(df, FINANCIAL)).when(F.coalesce("dominio", F.lit("academico")) == "academico", _lines(df, ACADEMIC)).otherwise(_lines(df, GENERAL))
    head = F.concat_ws("\n", F.concat(F.lit("Documento: "), F.col("nome_arquivo")), F.concat(F.lit("Tipo: "), X.nonblank("tipo_documento")))
    return df.select("md5", F.concat_ws("\n", head, body, *([X.nonblank(text_col)] if text_col else [])).alias("relatorio"))


def numbered(df: DataFrame, key: str = "md5") -> DataFrame:
    """Rows with pos, their place in key order: ranks inside range partitions plus the counts of those before.

    The ranges are written with the rows: read twice from one shuffle, they could be drawn together in two ways.
    """
    ranged = written(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    # one row per partition
    before = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("_p").orderBy(key))).drop("_p", "before")


def consolidated_report(df: DataFrame, reviewed: bool = False) -> DataFrame:
    """SNK-3: (pos, linha): a header with totals, then numbered entries in md5 order."""
    head = df.agg(F.concat(F.lit("Documentos: "), F.count("*"), F.lit(" | Com sucesso: "), F.count_if(F.col("status") == "sucesso")).alias("linha")).select(F.lit(0).cast("long").alias("pos"), "linha")
    who = F.coalesce(X.nonblank("beneficiario"), F.lit("-"))
    what = F.when(F.col("dominio") == "financeiro", F.coalesce(X.nonblank("valor_monetario"), F.lit("-"))).otherwise(F.coalesce(X.nonblank("curso"), F.lit("-")))
    parts = [F.col("nome_arquivo"), F.coalesce(X.nonblank("tipo_documento"), F.lit("-")), who, what, *([F.coalesce("status_conferencia", F.lit("pendente"))] if reviewed else [])]
    entries = numbered(df.select("md5", F.concat_ws(" | ", *parts).alias("linha")))
    return head.unionByName(entries.select("pos", F.concat_ws(" | ", F.col("pos").cast("string"), "linha").alias("linha"))).orderBy("pos")


#: The flat export's columns and their headers, in order.
HEADERS = {
    "beneficiario": "Beneficiario", "cpf": "CPF", "rg": "RG", "cnpj": "CNPJ", "faculdade": "Instituicao_Ensino", "curso": "Curso", "natureza_curso": "Natureza_Curso",
    "tipo_documento": "Tipo_Documento", "carga_horaria": "Carga_Horaria", "data": "Data_Documento", "status_conferencia": "Status_Conferencia", "revisado_em": "Revisado_Em",
    "observacoes_conferencia": "Observacoes_Conferencia", "status": "Status_Processamento", "metodo_leitura": "Metodo_Leitura", "tentativa_ocr_llm": "Tentativa_OCR_LLM",
    "erro": "Mensagem_Erro", "processado_em": "Processado_Em", "nome_arquivo": "Nome_Arquivo_PDF", "caminho_relativo": "Caminho_Relativo", "md5": "MD5",
    "data_modificacao": "Data_Ultima_Alteracao_PDF", "autor": "dc_creator", "dc_title": "dc_title", "dc_subject": "dc_subject", "dc_creator_tool": "dc_creator_tool",
}
LEFT_OUT = ["data_criacao", "dados_extras"]


def extras(df: DataFrame) -> DataFrame:
    """SNK-4, SRC-8: (md5, chave, valor), a row for each extra key of each document: keys as they are, texts bare, anything else as JSON, null for null.

    The bag is read as VARIANT and keys are never put into a path, so any key is found; what is no JSON object has none.
    """
    bags = df.select("md5", F.try_parse_json("dados_extras").alias("v")).filter("schema_of_variant(v) LIKE 'OBJECT%'")
    return bags.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("md5", F.col("key").alias("chave"), F.col("value").cast("string").alias("valor"))


def flat(df: DataFrame) -> DataFrame:
    """SNK-4: the 26 columns of the export under their headers (empty where df has none), then df's others and a column for every extra key.

    Yes and no for booleans, JSON for objects, no line ends, empty texts for nulls.  Extra keys are names
    from forms and become the header, so their list passes through the driver; `extras` has them without.
    """
    known = {c.lower() for c in [*df.columns, *HEADERS, *HEADERS.values()]}
    keys = sorted(r.chave for r in extras(df).select("chave").distinct().collect() if r.chave.lower() not in known)
    kinds = dict(df.dtypes)

    def shown(v: Column, kind: str) -> Column:
        told = F.when(v, "Sim").when(~v, "Não") if kind == "boolean" else F.to_json(v) if kind.startswith(("array", "map", "struct")) else v.cast("string")
        return F.trim(F.regexp_replace(F.coalesce(told, F.lit("")), r"\r?\n|\r", " "))

    fixed = [(shown(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(h) for c, h in HEADERS.items()]
    others = [shown(F.col(c), kinds[c]).alias(c) for c in df.columns if c not in HEADERS and c not in LEFT_OUT]
    # a bag that is no object has no keys
    bag = F.expr("CASE WHEN schema_of_variant(_bag) LIKE 'OBJECT%' THEN CAST(_bag AS MAP<STRING, VARIANT>) END")
    held = df.withColumn("_bag", F.try_parse_json("dados_extras")).withColumn("_bag", bag) if keys else df
    return held.select(*fixed, *others, *[shown(F.try_element_at("_bag", F.lit(k)).cast("string"), "string").alias(k) for k in keys])


def flat_csv(df: DataFrame, path: str) -> None:
    """The flat table as CSV: semicolons, everything quoted."""
    flat(df).write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).csv(path)
