"""A document registry derived from the driver's order tables, for tests and benchmarks.

The derivation is SQL text that Spark and DuckDB both read, so an oracle sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.sources.tables import kept


def _check(d: str, first: range | list, second: range | list) -> str:
    """SQL for d followed by its two mod-11 check digits."""

    def digit(text: str, weights) -> str:
        total = " + ".join(f"cast(substring({text}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))
        return f"(case when ({total}) % 11 < 2 then 0 else 11 - ({total}) % 11 end)"

    one = f"concat({d}, cast({digit(d, first)} as string))"
    return one, lambda text: f"concat({text}, cast({digit(text, second)} as string))"


_W = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_CPF1, _cpf2 = _check("b.c9", range(10, 1, -1), range(11, 1, -1))
_CNPJ1, _cnpj2 = _check("b.c12", _W, [6, *_W])

REGISTRY = f"""
WITH base AS (
  SELECT o.o_orderkey AS k, c.c_custkey AS ck, o.o_orderstatus AS st, o.o_orderpriority AS pr, o.o_orderdate AS od,
    cast(round(o.o_totalprice * 100) as bigint) AS cents, c.c_name AS cname, n.n_name AS nname,
    lpad(cast((c.c_custkey * 7919 + 12345) % 1000000000 as string), 9, '0') AS c9,
    concat(lpad(cast((c.c_custkey * 104729 + 777) % 100000000 as string), 8, '0'), '0001') AS c12
  FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey),
one AS (SELECT b.*, {_CPF1} AS cpf10, {_CNPJ1} AS cnpj13, cast(floor(cents / 100.0) as bigint) AS whole FROM base b),
two AS (SELECT b.*, {_cpf2("b.cpf10")} AS cpf11, {_cnpj2("b.cnpj13")} AS cnpj14 FROM one b)
SELECT
  md5(cast(k as string)) AS md5,
  concat('doc_', cast(k as string), case when k % 5 = 0 then '.PDF' when k % 5 = 1 then '.docx' when k % 5 = 2 then '.png' when k % 5 = 3 then '.txt' else '.pdf' end) AS nome_arquivo,
  case when k % 7 = 0 then null when k % 5 = 0 then '.pdf' when k % 5 = 1 then '.docx' when k % 5 = 2 then '.png' when k % 5 = 3 then '.txt' else '.pdf' end AS extensao,
  case when k % 13 = 0 then null when pr = '1-URGENT' then 'academico' when pr = '2-HIGH' then 'financeiro' when pr = '3-MEDIUM' then 'identificacao'
       when pr = '5-LOW' then 'veicular' when k % 2 = 0 then 'profissional' else 'juridico' end AS dominio,
  case when k % 29 = 0 then null
       when pr = '1-URGENT' then case when k % 3 = 0 then 'Diploma' when k % 3 = 1 then 'Certificado' else 'Histórico Escolar' end
       when pr = '2-HIGH' then case when k % 3 = 0 then 'Comprovante PIX' when k % 3 = 1 then 'Boleto Bancário' else 'Recibo' end
       when pr = '3-MEDIUM' then case when k % 3 = 0 then 'RG' when k % 3 = 1 then 'CPF' else 'Certidão de Nascimento' end
       when pr = '5-LOW' then case when k % 2 = 0 then 'Laudo de Vistoria Veicular' else 'Guia de Remoção de Veículo' end
       when k % 2 = 0 then 'Currículo' else 'Contrato de Compra e Venda' end AS tipo_documento,
  case when k % 4 = 0 then 'Diploma, RG' when k % 4 = 1 then 'recibo' when k % 6 = 2 then 'Documento, Procuração' else null end AS todos_tipos_texto,
  case when ck % 11 = 0 then null when ck % 3 = 0 then upper(cname) else cname end AS beneficiario,
  case when ck % 5 = 0 then null
       when ck % 7 = 0 then concat(substring(cpf11, 1, 3), '.', substring(cpf11, 4, 3), '.', substring(cpf11, 7, 3), '-', case when substring(cpf11, 10, 2) = '00' then '11' else '00' end)
       else concat(substring(cpf11, 1, 3), '.', substring(cpf11, 4, 3), '.', substring(cpf11, 7, 3), '-', substring(cpf11, 10, 2)) end AS cpf,
  case when ck % 6 = 0 then concat('MG-', lpad(cast(ck as string), 8, '1')) else null end AS rg,
  case when ck % 4 = 0 then cnpj14 when ck % 4 = 1 and ck % 9 = 0 then concat(substring(cnpj14, 1, 13), 'x') else null end AS cnpj,
  case when k % 3 = 0 then null when k % 3 = 1 then 'Pedagogia' else 'Direito' end AS curso,
  case when k % 8 = 0 then 'Graduação' when k % 8 = 1 then 'Pós-Graduação Lato Sensu' when k % 8 = 2 then 'MESTRADO' when k % 8 = 3 then 'Curso técnico'
       when k % 8 = 4 then 'extensão' when k % 8 = 5 then 'Ensino Médio' else null end AS natureza_curso,
  case when k % 10 = 0 then null when k % 10 = 1 then 'sem carga' when k % 10 < 5 then concat(cast(k % 1500 as string), ' horas') when k % 10 < 8 then concat('Carga: ', cast(k % 400 as string), 'h') else cast(k % 30 as string) end AS carga_horaria,
  case when ck % 10 = 0 then null when ck % 10 = 1 then 'N/A' when ck % 10 < 4 then concat(substring(nname, 1, 3), ' - faculdade de ', lower(nname)) when ck % 10 < 6 then concat('FACULDADE DE ', nname)
       when ck % 10 < 8 then concat('Faculdade de ', nname, ' LTDA') else concat('(', substring(nname, 1, 3), ') faculdade de ', lower(nname)) end AS faculdade,
  case when k % 9 = 0 then null else concat('R$ ',
       case when whole >= 1000000 then concat(cast(cast(floor(whole / 1000000.0) as bigint) as string), '.', lpad(cast(cast(floor(whole / 1000.0) as bigint) % 1000 as string), 3, '0'), '.', lpad(cast(whole % 1000 as string), 3, '0'))
            when whole >= 1000 then concat(cast(cast(floor(whole / 1000.0) as bigint) as string), '.', lpad(cast(whole % 1000 as string), 3, '0'))
            else cast(whole as string) end, ',', lpad(cast(cents % 100 as string), 2, '0')) end AS valor_monetario,
  case when k % 17 = 0 then null when k % 19 = 0 then '-' when k % 23 = 0 then 'sem ano' else concat(lpad(cast(day(od) as string), 2, '0'), '/', lpad(cast(month(od) as string), 2, '0'), '/', cast(year(od) as string)) end AS data,
  concat(lpad(cast(1 + k % 28 as string), 2, '0'), '/01/2024 10:00:00') AS data_modificacao,
  case when st = 'F' then 'sucesso' when st = 'O' then case when k % 2 = 0 then 'sucesso' else 'pendente' end else 'erro' end AS status,
  case when k % 23 = 0 then null when st = 'F' and k % 3 = 0 then 'aprovado' else 'pendente' end AS status_conferencia,
  case when k % 4 < 2 then 'texto_digital' when k % 4 = 2 then 'ocr_tesseract' else 'llm_visao' end AS metodo_leitura,
  case when st = 'P' then 'OCR falhou' else null end AS erro,
  k % 2 = 0 AS eh_nativo_digital,
  k % 10 = 0 AS tem_assinatura_digital,
  k % 6 = 0 AS tentativa_ocr_llm,
  case when k % 31 = 0 then md5(cast(k - 1 as string)) else null end AS duplicata_de,
  case when k % 12 = 0 then concat('Rua ', nname, ', ', cast(k % 100 as string)) else null end AS endereco_completo,
  case when k % 14 = 0 then concat('Pagador ', nname) else null end AS fonte_pagadora,
  case when k % 28 = 0 then cnpj14 else null end AS cnpj_fonte_pagadora,
  case when ck % 11 = 0 and k % 2 = 0 then concat('Empresa ', nname) else null end AS razao_social,
  case when k % 21 = 0 then concat('Vendedor ', cast(k % 50 as string)) else null end AS vendedor,
  case when k % 4 = 0 then concat('{{{{"pix_chave":"chave', cast(k % 90 as string), '","emitente":"Emitente ', cast(k % 40 as string), '","n":', cast(k % 7 as string), '}}}}') else null end AS dados_extras
FROM two
"""

PAGES = """
WITH base AS (
  SELECT md5(cast(l_orderkey as string)) AS md5, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_shipdate AS sd, l_extendedprice AS ep, l_quantity AS qt,
    case when (l_partkey + l_suppkey) % 9 = 0 then null when l_returnflag = 'R' then case when l_partkey % 4 = 0 then 'Folha de Cheque' when l_partkey % 4 = 1 then 'Recibo' else 'Comprovante PIX' end
         when l_returnflag = 'A' then case when l_partkey % 3 = 0 then 'RG' when l_partkey % 3 = 1 then 'CNH' else 'Contrato de Compra e Venda' end
         when l_partkey % 5 = 0 then 'Diploma' when l_partkey % 5 = 1 then 'Declaração de Imposto de Renda' when l_partkey % 5 = 2 then 'Recibo de Entrega da Declaração de Ajuste Anual'
         when l_partkey % 5 = 3 then 'Laudo de Vistoria Veicular' else 'Guia de Remoção de Veículo' end AS tipo,
    case when (l_partkey + l_suppkey) % 9 = 0 then 'outros' when l_returnflag = 'R' then 'financeiro' when l_returnflag = 'A' then case when l_partkey % 3 = 2 then 'juridico' else 'identificacao' end
         when l_partkey % 5 = 0 then 'academico' when l_partkey % 5 < 3 then 'financeiro' else 'veicular' end AS dominio
  FROM {lineitem})
SELECT md5, cast(row_number() OVER (PARTITION BY md5 ORDER BY ln, pk, sk, sd, ep, qt, tipo) as int) AS pagina, tipo, dominio,
  case when pk % 3 = 0 then concat('cpf', cast(pk % 100 as string)) else null end AS cpf,
  case when pk % 4 = 0 then concat('rg', cast(pk % 100 as string)) else null end AS rg,
  case when sk % 5 = 0 then concat('cnpj', cast(sk as string)) else null end AS cnpj,
  case when dominio = 'academico' and pk % 2 = 0 then 'Pedagogia' else null end AS curso,
  case when pk % 6 = 0 then 'as partes do contrato e a clausula segunda' else 'texto livre' end AS texto,
  case when tipo = 'Folha de Cheque' then lpad(cast(pk % 40 as string), 6, '0') else null end AS numero_cheque
FROM base
"""


# Papers of twelve kinds, by turns; the columns beside texto are what is written in it.
FORMS = f"""
WITH base AS (
  SELECT o.o_orderkey AS k, c.c_custkey AS ck, o.o_orderkey % 12 AS modelo, cast(round(o.o_totalprice * 100) as bigint) AS cents,
    lpad(cast((c.c_custkey * 7919 + 12345) % 1000000000 as string), 9, '0') AS c9,
    concat(lpad(cast((c.c_custkey * 104729 + 777) % 100000000 as string), 8, '0'), '0001') AS c12,
    cast(2014 + o.o_orderkey % 9 as string) AS ano,
    concat(case when c.c_custkey % 5 = 0 then 'Maria' when c.c_custkey % 5 = 1 then 'José' when c.c_custkey % 5 = 2 then 'Ana' when c.c_custkey % 5 = 3 then 'Íris' else 'Paulo' end, ' ',
      case when o.o_orderkey % 7 < 2 then 'Silva' when o.o_orderkey % 7 < 4 then 'Souza Lima' when o.o_orderkey % 7 = 4 then 'Araújo' else 'Dias' end) AS nome
  FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey),
one AS (SELECT b.*, {_CPF1} AS cpf10, {_CNPJ1} AS cnpj13 FROM base b),
two AS (SELECT b.*, {_cpf2("b.cpf10")} AS cpf11, {_cnpj2("b.cnpj13")} AS cnpj14 FROM one b),
parts AS (SELECT k, modelo, ano, nome, md5(cast(k as string)) AS md5,
  concat(substring(cpf11, 1, 3), '.', substring(cpf11, 4, 3), '.', substring(cpf11, 7, 3), '-', substring(cpf11, 10, 2)) AS cpf,
  concat(substring(cnpj14, 1, 2), '.', substring(cnpj14, 3, 3), '.', substring(cnpj14, 6, 3), '/', substring(cnpj14, 9, 4), '-', substring(cnpj14, 13, 2)) AS cnpj,
  concat('00190.00009 03183.378003 ', lpad(cast(k % 100000 as string), 5, '0'), '.500170 6 ', lpad(cast(cents as string), 14, '0')) AS linha,
  concat('00', lpad(cast(k % 1000000 as string), 6, '0'), '-7') AS nosso,
  cast(100000 + k % 900000 as string) AS numero_cheque, lpad(cast(k % 1000 as string), 3, '0') AS serie, concat(lpad(cast(ck % 1000000 as string), 6, '0'), '-1') AS conta,
  concat('12.34.56.78.', lpad(cast(k % 100 as string), 2, '0'), '-', lpad(cast(ck % 100 as string), 2, '0')) AS recibo,
  concat('ABC', lpad(cast(k % 10000 as string), 4, '0')) AS placa, lpad(cast(k + 10000000000 as string), 11, '0') AS renavam, concat('9BWZZZ377VT', lpad(cast(k % 1000000 as string), 6, '0')) AS chassi,
  cast(1 + k % 9000 as string) AS numero_nota, concat(lpad(cast(1 + k % 28 as string), 2, '0'), '/05/2024') AS vencimento,
  concat(cast(1 + k % 999 as string), '.', lpad(cast(ck % 1000 as string), 3, '0'), ',', lpad(cast(cents % 100 as string), 2, '0')) AS valor,
  case when k % 24 < 12 then 'Pedagogia' else 'Ciências Contábeis' end AS curso, concat('MG-', cast(10000000 + k as string)) AS rg,
  concat('pessoa', cast(k as string), '@exemplo.com') AS chave, concat('E12345678', lpad(cast(k as string), 22, '0')) AS e2e, concat('A1B2.C3D4-', cast(k as string)) AS autenticacao,
  case when k % 24 < 12 then 'ATIVA' else 'BAIXADA' end AS situacao, concat('EMPRESA ', upper(nome), ' LTDA') AS razao, cast(1 + k % 900 as string) AS numero_rua
  FROM two)
SELECT *, case modelo
  when 0 then concat('Ficha de Compensação', chr(10), 'Recibo do Pagador', chr(10), 'Nosso Número: ', nosso, chr(10), linha, chr(10), 'Beneficiário: ', nome, chr(10), 'CPF ', cpf, chr(10))
  when 1 then concat('Banco do Brasil S.A.', chr(10), 'Agência: 1234-5', chr(10), 'Conta Corrente: ', conta, chr(10), 'Série: ', serie, chr(10), 'Cheque nº: ', numero_cheque, chr(10), case when k % 24 = 1 then concat('Cheque nº: ', cast(cast(numero_cheque as int) + 1 as string), chr(10)) else '' end, 'Pague por este cheque a quantia de cem reais', chr(10))
  when 2 then concat('Ministério da Fazenda', chr(10), 'Receita Federal', chr(10), case when k % 24 = 2 then 'Recibo de Entrega da ' else '' end, 'Declaração de Ajuste Anual', chr(10), 'Exercício: ', cast(cast(ano as int) + 1 as string), chr(10), 'Ano-Calendário: ', ano, chr(10), recibo, chr(10), 'C.P.F: ', replace(replace(cpf, '.', ''), '-', ''), chr(10))
  when 3 then concat('Informe de Rendimentos Financeiros', chr(10), 'Fonte Pagadora: Banco Bradesco', chr(10), 'CNPJ ', cnpj, chr(10), 'Ano-Calendário de ', ano, chr(10), 'Nome: ', nome, chr(10))
  when 4 then concat('Certificado de Registro e Licenciamento de Veículo', chr(10), 'Placa ', placa, chr(10), 'RENAVAM: ', renavam, chr(10), 'Chassi: ', chassi, chr(10))
  when 5 then concat('Compromisso de Compra e Venda', chr(10), 'Promitente Vendedor: ', nome, chr(10), 'C.I. n. ', rg, ' SSP/MG, CPF: ', cpf, chr(10), case when k % 24 < 12 then 'Imóvel residencial' else 'Sala comercial' end, chr(10))
  when 6 then concat('Nota Promissória', chr(10), 'Nº ', numero_nota, chr(10), 'Valor: R$ ', valor, chr(10), 'Vencimento: ', vencimento, chr(10), 'Pagável a esta praça', chr(10))
  when 7 then concat('RECIBO', chr(10), 'Recebi de ', nome, ' a importância de R$ ', valor, ' referente a serviços', chr(10), 'Pago por CPF nº ', cpf, chr(10))
  when 8 then concat('Diploma', chr(10), 'A escola conferiu o grau pela conclusão do curso de ', curso, ', em 2010', chr(10), 'Carteira de Identidade ', rg, ' SSP/MG', chr(10), 'Aluno: ', nome, chr(10))
  when 9 then concat('Comprovante PIX', chr(10), 'Valor: R$ ', valor, chr(10), 'Chave PIX: ', chave, chr(10), 'ID da transação: ', e2e, chr(10), 'Autenticação: ', autenticacao, chr(10))
  when 10 then concat('COMPROVANTE DE INSCRIÇÃO E DE SITUAÇÃO CADASTRAL', chr(10), 'CNPJ: ', cnpj, chr(10), 'NOME EMPRESARIAL: ', razao, chr(10), 'LOGRADOURO: RUA DAS FLORES NÚMERO: ', numero_rua, chr(10), 'MUNICÍPIO: VITÓRIA UF: ES', chr(10), 'SITUAÇÃO CADASTRAL: ', situacao, chr(10), 'DATA DE ABERTURA: ', vencimento, chr(10), 'TELEFONE: (27) 3333-', lpad(numero_rua, 4, '0'), chr(10))
  else concat('Listagem de pagamentos', chr(10), valor, ' ', upper(nome), ' 1 5610 000123', chr(10), 'Favorecido: ', nome, chr(10), 'Titular: BANCO DO ESTADO', chr(10)) end AS texto
FROM parts
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Orders of one file of the tables made from them: their rows cost far more to read than their bytes tell.
PER_FILE = 20_000


def parts_of(rows: DataFrame, size: int) -> int:
    """How many parts of `size` rows a table makes."""
    return -(-rows.count() // size) or 1


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders in as many parts as their number asks for, however few files hold them."""
    orders = read(spark, sf_dir, "orders")
    return orders.repartition(parts_of(orders, PER_FILE), "o_orderkey")


#: How the SQL brings orders, customers and nations together.
JOINED = "{orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"
NATIONS = " JOIN {nation} n ON c.c_nationkey = n.n_nationkey"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over orders and their customers, which are brought together first and then dealt out.

    A join of large tables deals its rows by their bytes; what is computed of a row costs far more than they tell.
    """
    whole = lambda t, a: read(spark, sf_dir, t).select(F.struct("*").alias(a))
    orders = whole("orders", "o")
    rows = orders.join(whole("customer", "c"), F.col("o.o_custkey") == F.col("c.c_custkey"))
    if NATIONS in sql:
        rows = rows.join(whole("nation", "n"), F.col("c.c_nationkey") == F.col("n.n_nationkey"))
    rows = rows.repartition(parts_of(orders, PER_FILE), "o.o_orderkey")
    return spark.sql(sql.replace(JOINED, "{rows}").replace(NATIONS, ""), rows=rows)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the registry columns the operators use."""
    return kept(spark, "registry", sf_dir, lambda: derived(spark, sf_dir, REGISTRY))


def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry for a query that passes over it once: where it is not kept yet, only the columns asked for are made."""
    return kept(spark, "registry", sf_dir) or derived(spark, sf_dir, REGISTRY)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper's text for each order, of twelve kinds, with what is written in it."""
    return kept(spark, "forms", sf_dir, lambda: derived(spark, sf_dir, FORMS))


#: Order lines of one file of the pages made from them.
LINES = 100_000


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return spark.sql(PAGES, lineitem=lines.repartition(parts_of(lines, LINES), F.md5(F.col("l_orderkey").cast("string"))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows of the registry's documents, from the order lines, in as many parts as their number asks for."""
    return kept(spark, "pages", sf_dir, lambda: _paged(spark, sf_dir))


def passed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages for a query that needs few of their columns: where they are not kept yet, only those are made."""
    return kept(spark, "pages", sf_dir) or _paged(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as registry rows with a transcript."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.md5(F.col("doc_id").cast("string")).alias("md5"), "doc_id", F.concat(F.lit("texto_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("nome_arquivo"), F.col("text").alias("texto"), "source", "lang")


#: The same tables as DuckDB SQL.
REGISTRY_SQL = REGISTRY.format(orders="orders", customer="customer", nation="nation").replace("{{", "{").replace("}}", "}")
PAGES_SQL = PAGES.format(lineitem="lineitem")
FORMS_SQL = FORMS.format(orders="orders", customer="customer")
