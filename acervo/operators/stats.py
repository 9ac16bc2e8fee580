"""Management statistics and pivots over the registry (AGG-1..26, SNK-6, SNK-7).

Every block is one aggregation over the enriched registry; partial sums are map-side,
and rank-and-remainder charts work on the aggregated rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import text as X

UNKNOWN_CLASS, NO_VALUE = "Não identificado", "Sem Valor Declarado"
CUTS = (1000.0, 10000.0, 100000.0)


def enrich(df: DataFrame) -> DataFrame:
    """Typed columns used by every block: valor, classe, conferencia, dom."""
    return df.withColumns({
        "valor": X.parse_money("valor_monetario"),
        "classe": F.coalesce(F.nullif("tipo_documento", F.lit("")), F.lit(UNKNOWN_CLASS)),
        "conferencia": F.coalesce(F.nullif("status_conferencia", F.lit("")), F.lit("pendente")),
        "dom": F.coalesce(F.nullif("dominio", F.lit("")), F.lit("outro")),
    })


def pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(0.0)


def amount(v: Column | str) -> Column:
    """The sum of amounts as a double, added as decimals: no order of the rows changes a digit, whatever the total."""
    return F.sum(X.col(v).cast("decimal(28,6)")).cast("double")


def money(x: Column) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)), 2)


def kpis(df: DataFrame) -> DataFrame:
    """AGG-1: documents, and sum, mean and maximum of the positive values."""
    v = F.when(F.col("valor") > 0, F.col("valor"))
    return enrich(df).agg(F.count("*").alias("documentos"), F.count(v).alias("com_valor"), money(amount(v)).alias("total"), money(amount(v) / F.count(v)).alias("ticket_medio"), money(F.max(v)).alias("maior"))


def class_distribution(df: DataFrame, limit: int | None = None) -> DataFrame:
    """AGG-2, AGG-16: documents and amount per class, most frequent first."""
    out = enrich(df).groupBy("classe").agg(F.count("*").alias("documentos"), money(amount("valor")).alias("valor_total")).orderBy(F.desc("documentos"), "classe")
    return out if limit is None else out.limit(limit)


def value_counts(df: DataFrame) -> DataFrame:
    """AGG-3: review states and domains, stacked as (grupo, valor, documentos)."""
    both = F.explode(F.array(*[F.struct(F.lit(g).alias("grupo"), F.col(c).alias("valor")) for g, c in (("status_conferencia", "conferencia"), ("dominio", "dom"))]))
    return enrich(df).select(both.alias("x")).groupBy("x.grupo", "x.valor").agg(F.count("*").alias("documentos"))


def preponderant_domain(df: DataFrame, strict: bool = False) -> DataFrame:
    """AGG-4: the most frequent domain, its share, and whether it is a majority (at least, or with strict above, half)."""
    by = enrich(df).groupBy("dom").agg(F.count("*").alias("n"), F.min("md5").alias("first"))
    top = by.agg(F.sum("n").alias("total"), F.max("n").alias("n"))  # one row
    named = by.join(F.broadcast(top.select("total", F.col("n").alias("most"))), F.col("n") == F.col("most")).agg(F.min_by("dom", "first").alias("dominio"), F.max("n").alias("documentos"), F.max("total").alias("total"))
    share = pct(F.col("documentos"), F.col("total"))
    return named.select("dominio", "documentos", share.alias("percentual"), ((share > 50.0) if strict else (share >= 50.0)).alias("eh_maioria"))


def flag_counts(df: DataFrame) -> DataFrame:
    """AGG-5."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return df.agg(yes("tem_assinatura_digital"), yes("eh_nativo_digital"), F.count_if(X.present("duplicata_de")).alias("duplicatas"))


def bracket(valor: Column, cuts=CUTS) -> Column:
    """Number of the value bracket; 4 for no value."""
    a, b, c = cuts
    return F.when(valor <= 0, 4).when(valor <= a, 0).when(valor <= b, 1).when(valor <= c, 2).otherwise(3)


def bracket_labels(cuts=CUTS) -> list[str]:
    a, b, c = (f"{x:,.0f}".replace(",", ".") for x in cuts)
    return [f"Até R$ {a}", f"R$ {a} a {b}", f"R$ {b} a {c}", f"Acima de R$ {c}", NO_VALUE]


def value_brackets(df: DataFrame, cuts=CUTS) -> DataFrame:
    """AGG-6: documents and amount per value bracket, empty brackets included; cuts count only if there are three."""
    cuts = tuple(sorted(cuts)) if cuts is not None and len(cuts) == 3 else CUTS
    found = enrich(df).groupBy(bracket(F.col("valor"), cuts).alias("faixa")).agg(F.count("*").alias("n"), amount("valor").alias("v"))
    names = df.sparkSession.createDataFrame(list(enumerate(bracket_labels(cuts))), "faixa int, rotulo string")
    return F.broadcast(names).join(found, "faixa", "left").select("faixa", "rotulo", F.coalesce("n", F.lit(0)).alias("documentos"), money(F.col("v")).alias("valor_total"))


def distinct_entities(df: DataFrame, valid_only: bool = False, approximate: bool = False) -> DataFrame:
    """AGG-7: distinct cpfs, cnpjs and holders; valid_only keeps checked digits and holders of three letters or more."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    if valid_only:
        cpf, cnpj = F.when(X.valid_cpf("cpf"), X.digits("cpf")), F.when(X.valid_cnpj("cnpj"), X.digits("cnpj"))
        name = F.when(F.length(F.trim("beneficiario")) >= 3, F.lower(F.trim("beneficiario")))
    else:
        cpf, cnpj, name = X.nonblank("cpf"), X.nonblank("cnpj"), X.nonblank("beneficiario")
    return df.agg(count(cpf).alias("cpfs"), count(cnpj).alias("cnpjs"), count(name).alias("beneficiarios"))


def top_holders(df: DataFrame, limit: int = 10) -> DataFrame:
    """AGG-8: holders by documents, with amounts; a document without holder counts for 'CPF …'."""
    name = F.coalesce(X.nonblank("beneficiario"), F.when(X.present("cpf"), F.concat(F.lit("CPF "), F.trim("cpf"))))
    by = enrich(df).withColumn("nome", name).filter("nome is not null").groupBy("nome").agg(F.count("*").alias("documentos"), money(amount("valor")).alias("valor_total"), F.min("md5").alias("_first"))
    return by.orderBy(F.desc("documentos"), "_first").limit(limit).drop("_first")


def temporal(df: DataFrame) -> DataFrame:
    """AGG-9: documents and amount by the first year in the date text."""
    day, year = F.trim(F.coalesce("data", F.lit(""))), X.extract_year("data")
    label = F.when(day.isin("", "-"), "Sem Data").otherwise(F.coalesce(year.cast("string"), F.lit("Indeterminado")))
    return enrich(df).groupBy(label.alias("ano")).agg(F.count("*").alias("documentos"), money(amount("valor")).alias("valor_total")).orderBy("ano")


def reliability(df: DataFrame) -> DataFrame:
    """AGG-10."""
    low = X.present("erro") | F.col("classe").isin(UNKNOWN_CLASS, "Desconhecido")
    high = F.coalesce((F.col("metodo_leitura") == "texto_digital") | (F.col("conferencia") == "aprovado"), F.lit(False))
    tier = F.when(low, "baixa").when(high, "alta").otherwise("media")
    return enrich(df).withColumn("t", tier).agg(*[F.count_if(F.col("t") == x).alias(x) for x in ("alta", "media", "baixa")])


def quality(df: DataFrame) -> DataFrame:
    """AGG-11: shares of documents with ids, value, date, holder, signature and approval."""
    tests = {
        "pct_cpf_cnpj": X.present("cpf") | X.present("cnpj"), "pct_valor": F.col("valor") > 0, "pct_data": ~F.trim(F.coalesce("data", F.lit(""))).isin("", "-"),
        "pct_beneficiario": X.present("beneficiario"), "pct_assinado": F.coalesce("tem_assinatura_digital", F.lit(False)), "pct_aprovado": F.col("conferencia") == "aprovado",
    }
    return enrich(df).agg(*[pct(F.count_if(t), F.count("*")).alias(n) for n, t in tests.items()])


#: The domains of the chart.
CHART_DOMAINS = ["financeiro", "juridico", "identificacao", "cadastral", "academico", "veicular", "outro"]


def domain_chart(df: DataFrame) -> DataFrame:
    """AGG-12: seven domains, zero-filled; profissional counts as cadastral, anything unknown as outro."""
    d = F.lower("dom")
    d = F.when(d == "profissional", "cadastral").when(d.isin(CHART_DOMAINS), d).otherwise("outro")
    found = enrich(df).groupBy(d.alias("dominio")).agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(x,) for x in CHART_DOMAINS], "dominio string")
    return F.broadcast(names).join(found, "dominio", "left").select("dominio", F.coalesce("n", F.lit(0)).alias("documentos"))


def type_chart(df: DataFrame, top: int = 7) -> DataFrame:
    """AGG-13: the most frequent classes and the rest as one."""
    name = F.coalesce(X.nonblank("tipo_documento"), F.lit("Não especificado"))
    by = df.groupBy(name.alias("tipo")).agg(F.count("*").alias("documentos"), F.min("md5").alias("first"))
    first = by.orderBy(F.desc("documentos"), "first").limit(top).select(F.col("tipo").alias("kept"))
    # at most `top` rows are broadcast
    return by.join(F.broadcast(first), F.col("tipo") == F.col("kept"), "left").groupBy(F.coalesce("kept", F.lit("Outros Subtipos")).alias("tipo")).agg(F.sum("documentos").alias("documentos"))


def level_chart(df: DataFrame) -> DataFrame:
    """AGG-14."""
    return df.groupBy(X.academic_level("natureza_curso").alias("nivel")).agg(F.count("*").alias("documentos"))


def hours_chart(df: DataFrame) -> DataFrame:
    """AGG-15."""
    h = X.extract_hours("carga_horaria")
    label = F.when(h.isNull(), "Não informada").when(h < 40, "< 40h (Curta Duração)").when(h < 180, "40h a 179h (Extensão)").when(h < 360, "180h a 359h (Capacitação)").when(h < 1000, "360h a 999h (Especialização/MBA)").otherwise("≥ 1000h (Graduação/Técnico)")
    return df.groupBy(label.alias("faixa")).agg(F.count("*").alias("documentos"))


def timeline(df: DataFrame) -> DataFrame:
    """AGG-17: years from 1970 to 2035."""
    return enrich(df).withColumn("ano", X.extract_year("data", 1970, 2035)).filter("ano is not null").groupBy("ano").agg(F.count("*").alias("documentos"), money(amount("valor")).alias("valor_total")).orderBy("ano")


def top_institutions(df: DataFrame, limit: int = 10) -> DataFrame:
    """AGG-18: normalised institutions by documents."""
    by = df.withColumn("instituicao", X.normalize_institution("faculdade")).filter("instituicao is not null").groupBy("instituicao").agg(F.count("*").alias("documentos"))
    return by.orderBy(F.desc("documentos"), "instituicao").limit(limit)


def top_people(df: DataFrame, limit: int = 10) -> DataFrame:
    """AGG-18: holders of three letters or more that are not 'não informado'."""
    name = F.trim("beneficiario")
    by = df.withColumn("nome", name).filter((F.length("nome") >= 3) & (F.lower("nome") != "não informado")).groupBy("nome").agg(F.count("*").alias("documentos"))
    return by.orderBy(F.desc("documentos"), "nome").limit(limit)


def funnel(df: DataFrame) -> DataFrame:
    """AGG-19: shares of native, readable, reliable and approved documents."""
    high = (F.col("metodo_leitura") == "texto_digital") | (F.col("conferencia") == "aprovado")
    tests = {"nativos": F.coalesce("eh_nativo_digital", F.lit(False)), "com_texto": ~F.coalesce(F.col("status") == "erro", F.lit(False)), "alta_confiabilidade": F.coalesce(high, F.lit(False)), "aprovados": F.col("conferencia") == "aprovado"}
    return enrich(df).agg(*[pct(F.count_if(t), F.count("*")).alias(n) for n, t in tests.items()])


def pivot_domain_review(df: DataFrame) -> DataFrame:
    """AGG-20: domain by review state with totals of rows, columns and all, and shares of all."""
    by = enrich(df).cube("dom", "conferencia").agg(F.count("*").alias("documentos"), F.grouping_id().alias("g"))
    name = lambda c, bit: F.when(F.col("g").bitwiseAND(bit) > 0, "Total").otherwise(F.col(c))
    total = by.filter("g = 3").select(F.col("documentos").alias("tudo"))
    return by.crossJoin(F.broadcast(total)).select(name("dom", 2).alias("dominio"), name("conferencia", 1).alias("estado"), "documentos", pct(F.col("documentos"), F.col("tudo")).alias("percentual"))


def pivot_class_bracket(df: DataFrame, top: int = 8, cuts=CUTS) -> DataFrame:
    """AGG-21: the most frequent classes by value bracket, with row totals."""
    rows = enrich(df).withColumn("faixa", bracket(F.col("valor"), cuts))
    kept = rows.groupBy("classe").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "classe").limit(top).select("classe")
    shown = rows.join(F.broadcast(kept), "classe", "left_semi")
    return shown.groupBy("classe").agg(*[F.count_if(F.col("faixa") == i).alias(f"faixa_{i}") for i in range(5)], F.count("*").alias("total"))


def pivot_level_type(df: DataFrame) -> DataFrame:
    """AGG-22: academic level by kind of document."""
    t = X.fold("tipo_documento")
    kind = F.when(t.contains("diploma"), "diploma").when(t.contains("certificado"), "certificado").when(t.contains("historico"), "historico").when(t.contains("declaracao") | t.contains("atestado"), "declaracao").otherwise("outro")
    kinds = ["diploma", "certificado", "historico", "declaracao", "outro"]
    return df.select(X.academic_level("natureza_curso").alias("nivel"), kind.alias("k")).groupBy("nivel").agg(*[F.count_if(F.col("k") == x).alias(x) for x in kinds], F.count("*").alias("total"))


def unification(df: DataFrame) -> DataFrame:
    """AGG-24: what unifying the institutions' names changes."""
    new, old = X.normalize_institution("faculdade"), X.nonblank("faculdade")
    out = df.select(old.alias("old"), new.alias("new")).agg(F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("alterados"), F.count_distinct("old").alias("distintos_antes"), F.count_distinct(F.coalesce("new", "old")).alias("distintos_depois"))
    return out.withColumn("reducao", F.col("distintos_antes") - F.col("distintos_depois"))


def unification_samples(df: DataFrame, limit: int = 15) -> DataFrame:
    """AGG-24: the first mappings."""
    new, old = X.normalize_institution("faculdade"), X.nonblank("faculdade")
    return df.select(old.alias("de"), new.alias("para")).filter("de != para").distinct().orderBy("de").limit(limit)


def run_summary(df: DataFrame) -> DataFrame:
    """AGG-25."""
    s = F.col("status")
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status_conferencia") == "aprovado").alias("ja_conferidos"), F.count_if(s == "sucesso").alias("sucessos"), F.count_if(s == "erro").alias("erros"), F.count_if(~s.isin("sucesso", "erro")).alias("pendentes"))


def corpus_counters(df: DataFrame) -> DataFrame:
    """AGG-26: academic, financial and other documents."""
    d = F.coalesce("dominio", F.lit("academico"))
    return df.agg(F.count_if(d == "academico").alias("academicos"), F.count_if(d == "financeiro").alias("financeiros"), F.count_if(~d.isin("academico", "financeiro")).alias("outros"))


def bi_csv(df: DataFrame) -> DataFrame:
    """SNK-6: (secao, categoria, documentos, percentual, valor) for domains, then classes."""
    rows = enrich(df)
    total = rows.agg(F.count("*").alias("tudo"))
    parts = [rows.groupBy(F.col(c).alias("categoria")).agg(F.count("*").alias("documentos"), money(amount("valor")).alias("valor")).withColumn("secao", F.lit(s)) for s, c in (("Domínio", "dom"), ("Tipo", "classe"))]
    return parts[0].unionByName(parts[1]).crossJoin(F.broadcast(total)).select("secao", "categoria", "documentos", pct(F.col("documentos"), F.col("tudo")).alias("percentual"), "valor")


def bi_summary(df: DataFrame, classes: int = 15) -> DataFrame:
    """SNK-7: lines (ordem, linha) of an executive summary."""
    head = kpis(df).select(F.lit(0).alias("ordem"), F.concat_ws(" | ", F.concat(F.lit("Documentos: "), F.col("documentos")), F.concat(F.lit("Com valor: "), F.col("com_valor")), F.concat(F.lit("Total: "), X.format_brl("total")), F.concat(F.lit("Ticket: "), X.format_brl("ticket_medio"))).alias("linha"))
    line = F.concat(F.col("c"), F.lit(": "), F.col("documentos"))
    doms = enrich(df).groupBy(F.col("dom").alias("c")).agg(F.count("*").alias("documentos")).select(F.lit(1).alias("ordem"), line.alias("linha"))
    top = class_distribution(df, classes).withColumnRenamed("classe", "c").select(F.lit(2).alias("ordem"), line.alias("linha"))
    return head.unionByName(doms).unionByName(top)
