"""The registry's schema: one wide row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = (
    "md5 nome_arquivo caminho_relativo extensao dominio tipo_documento data_modificacao data autor beneficiario cpf rg cnpj curso natureza_curso carga_horaria "
    "faculdade valor_monetario status metodo_leitura erro processado_em status_conferencia conferido_em revisado_em observacoes_conferencia dc_title dc_subject "
    "dc_creator_tool duplicata_de info_assinaturas_json dossie_id caminho_organizado dados_extras"
).split()
PAGE = T.StructType([T.StructField("pagina", T.IntegerType()), T.StructField("tipo", T.StringType()), T.StructField("dominio", T.StringType())])
DOC_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("todos_dominios", "todos_tipos")]
    + [T.StructField(c, T.BooleanType()) for c in ("tentativa_ocr_llm", "eh_nativo_digital", "tem_assinatura_digital")]
    + [T.StructField("dossie_paginas", T.ArrayType(PAGE)), T.StructField("similaridade_duplicata", T.DoubleType()), T.StructField("dublin_core", T.MapType(T.StringType(), T.StringType()))]
)


def reconcile_schema(df: DataFrame) -> DataFrame:
    """The registry's columns in order: missing ones as typed nulls, others folded into dados_extras."""
    known = {f.name: f for f in DOC_SCHEMA.fields}
    more = [c for c in df.columns if c not in known]
    bag = F.col("dados_extras") if "dados_extras" in df.columns else F.lit(None).cast("string")
    if more:
        own = F.from_json(F.coalesce(bag, F.lit("{}")), "map<string,string>")
        new = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in more]), F.array(*[F.col(c).cast("string") for c in more])), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
        bag = F.to_json(F.map_concat(own, new))
    return df.select(*[bag.alias(n) if n == "dados_extras" else (F.col(n).cast(f.dataType) if n in df.columns else F.lit(None).cast(f.dataType).alias(n)) for n, f in known.items()])
