"""Literal input and output pairs of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from acervo.functions import classes as C
from acervo.functions import extract as T
from acervo.functions import text as X
from acervo.operators import classify as K
from acervo.operators import pages as P


def value(spark, fn, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first().x


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (X.format_cpf, "12345678909", "123.456.789-09"), (X.format_cpf, "", None), (X.format_cpf, None, None), (X.format_cpf, " 12 ", "12"),
        (X.valid_cpf, "111.444.777-35", True), (X.valid_cpf, "111.444.777-00", False), (X.valid_cpf, "000.000.000-00", False), (X.valid_cpf, "123456", False), (X.valid_cpf, None, False),
        (lambda c: X.valid_cpf(c, True), "11144477735", False), (lambda c: X.valid_cpf(c, True), "111.444.777-35", True),
        (X.valid_cnpj, "11.222.333/0001-81", True), (X.valid_cnpj, "11.222.333/0001-80", False),
        (X.parse_money, "R$ 1.250,50", 1250.5), (X.parse_money, "450,00", 450.0), (X.parse_money, "100.25", 100.25), (X.parse_money, None, 0.0), (X.parse_money, "x", 0.0),
        (lambda c: X.format_brl(X.parse_money(c)), "1250,5", "R$ 1.250,50"),
        (X.fold, "São Paulo - Educação e Saúde ", "sao paulo - educacao e saude"), (X.fold, None, ""),
        (X.sanitize_part, "Nome / com * barras ? e : dois_pontos", "Nome___com___barras___e___dois_pontos"), (X.sanitize_part, "", "Nao_Informado"),
        (X.extract_year, "18 de dezembro de 2023", 2023), (X.extract_year, "12/12/23", None),
        (X.extract_hours, "carga de 360 horas", 360), (X.extract_hours, "40h", 40), (X.extract_hours, "0", None),
        (X.title_pt, "FACULDADE DE NOVA ALDEIA (fna)", "Faculdade de NOVA Aldeia (FNA)"),
        (X.normalize_institution, "N/A", None), (X.normalize_institution, "  ", None), (X.normalize_institution, "FNA - faculdade nova aldeia", "Faculdade Nova Aldeia (FNA)"),
        (X.normalize_institution, "faculdade nova aldeia LTDA", "Faculdade Nova Aldeia"), (X.normalize_institution, "(fna) faculdade nova", "Faculdade Nova (FNA)"),
        (X.academic_level, "Pós-Graduação Lato Sensu", "Pós-Graduação Lato Sensu (Especialização/MBA)"), (X.academic_level, None, "Não identificada"),
        (X.normalize_for_compare, "Olá,  Mundo!\nÉ", "olá mundo é"),
        (C.type_to_domain, "Guia de Remoção de Veículo", "veicular"), (C.default_domain, "Comprovante de residência", "academico"), (C.tag_category, "Recibo", "Financeiro"),
        (T.extract_cpf, "C.P.F: 11144477735", "111.444.777-35"), (T.extract_cpf, "CPF 111.444.777-00", None), (T.extract_cnpj, "CNPJ: 11.222.333/0001-81", "11.222.333/0001-81"),
        (T.extract_rg, "RG 12.345.678-9 SSP/SP", "12.345.678-9 SSP/SP"), (T.extract_money, "Valor: R$ 1.234,56 pago", "R$ 1.234,56"), (T.extract_money, "nada", None),
        (T.extract_course, "conclusão do curso de Pedagogia, em 2010", "Pedagogia"), (T.extract_pix_key, "Chave PIX: fulano@exemplo.com", "fulano@exemplo.com"),
        (T.extract_names, "Titular: Ana Beatriz\nTitular: Ana Beatriz\nFavorecido: Carlos Dias", ["Ana Beatriz", "Carlos Dias"]),
        (P.sanitize_transcript, "linha igual aqui\n" * 5, None), (P.sanitize_transcript, "curto", None), (P.sanitize_transcript, "um texto comum\ncom duas linhas", "um texto comum\ncom duas linhas"),
        (lambda c: K.slip(c)["sim"], "00190.00009 03183.378003 00078.500170 6 12780001804302", True),
        (lambda c: K.slip(c)["linha"], "00190.00009 03183.378003 00078.500170 6 12780001804302", "00190.00009 03183.378003 00078.500170 6 12780001804302"),
        (lambda c: K.cheque(c)["numeros"], "Pague por este cheque nº 123456 a quantia", ["123456"]),
        (lambda c: K.signature(c)["tipo"], "a universidade confere o grau de bacharel em direito", "Diploma"), (lambda c: K.signature(c)["tipo"], "oi", None),
        (lambda c: K.signature(c)["tipo"], "Nota Promissória n. 12 vencimento 01/02/2020 avalista", "Nota Promissória"), (lambda c: K.signature(c)["dominio"], "certificado de registro e licenciamento detran", "veicular"),
        (lambda c: K.signature(c)["tipo"], "Recebi de fulano a importância de cem reais", "Recibo"),
    ],
)
def test_scalar(spark, fn, given, want):
    assert value(spark, fn, given) == want


def test_highlight(spark):
    row = spark.createDataFrame([("Índice e índice",)], "t string").select(*[c.alias(n) for c, n in zip(X.highlight("t", "índice"), ("s", "n"))]).first()
    assert (row.s, row.n) == ("<mark>Índice</mark> e <mark>índice</mark>", 2)


def test_company_card(spark):
    text = "NOME EMPRESARIAL: ALFA BETA LTDA\nSITUAÇÃO CADASTRAL: ATIVA\nLOGRADOURO: RUA UM\nNÚMERO: 10\nBAIRRO/DISTRITO: CENTRO\nMUNICÍPIO: VILA\nUF: MG\nCEP: 30.100-000"
    got = value(spark, T.extract_company_card, text)
    assert (got.razao_social, got.situacao_cadastral, got.endereco_completo) == ("ALFA BETA LTDA", "ATIVA", "RUA UM, 10 - CENTRO - VILA/MG - CEP 30.100-000")


def test_repair_json(spark):
    rows = [("1", '```json\n{"a": 1}\n```'), ("2", 'veja {"a": "b", "c": ["d'), ("3", '{"a": "x" "b": "y"}'), ("4", None)]
    got = {r.k: r.json for r in K.repair_json(spark.createDataFrame(rows, "k string, resposta string")).collect()}
    assert got == {"1": '{"a": 1}', "2": '{"a": "b", "c": ["d"]}', "3": '{"a":"x","b":"y"}', "4": None}
