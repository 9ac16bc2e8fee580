"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from acervo.adapter import FORMS_SQL, PAGES_SQL, REGISTRY_SQL
from acervo.functions import classes as C
from acervo.operators import pages as P
from acervo.operators.filters import NULL_LIKE
from acervo.sources import sinks

FOLD = "strip_accents(lower(trim(coalesce({0}, ''))))"
DIGITS = "regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g')"
BLANK = "(trim(coalesce({0}, '')) = '')"


def valor(c: str) -> str:
    kept = f"regexp_replace(coalesce({c}, ''), '[^0-9,.]', '', 'g')"
    return f"coalesce(try_cast(CASE WHEN contains({kept}, ',') THEN replace(replace({kept}, '.', ''), ',', '.') ELSE {kept} END AS DOUBLE), 0.0)"


def year(c: str) -> str:
    return f"try_cast(nullif(regexp_extract(coalesce({c}, ''), '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS INTEGER)"


def mod11(d: str, weights) -> str:
    total = " + ".join(f"coalesce(try_cast(substr({d}, {i + 1}, 1) AS INT), 0) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


def valid(c: str, size: int) -> str:
    d, w = DIGITS.format(c), [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    first, second = (list(range(10, 1, -1)), list(range(11, 1, -1))) if size == 11 else (w, [6, *w])
    return f"(length({d}) = {size} AND {d} <> repeat(substr({d}, 1, 1), {size}) AND {mod11(d, first)} = try_cast(substr({d}, {size - 1}, 1) AS INT) AND {mod11(d, second)} = try_cast(substr({d}, {size}, 1) AS INT))"


LEVEL = "CASE {} ELSE 'Não identificada' END".format(" ".join(
    f"WHEN regexp_matches({FOLD.format('natureza_curso')}, '{p}') THEN '{n}'" for p, n in (
        ("stricto|mestrado|doutorado", "Pós-Graduação Stricto Sensu (Mestrado/Doutorado)"),
        ("lato sensu|especializacao|mba|pos-graduacao|pos graduacao", "Pós-Graduação Lato Sensu (Especialização/MBA)"),
        ("graduacao|superior|bacharel|licenciatura|tecnologo", "Graduação / Curso Superior"),
        ("tecnico|profissionalizante", "Curso Técnico / Profissionalizante"),
        ("extensao|aperfeicoamento|capacitacao", "Curso de Extensão / Aperfeiçoamento"),
        ("basica|medio|fundamental", "Educação Básica"),
    )
))
HOURS = "(SELECT CASE WHEN h > 0 AND h < 20000 THEN h END FROM (SELECT try_cast(coalesce(nullif(regexp_extract(lower(carga_horaria), '([0-9]+)\\s*(?:horas?|hrs?|h)\\b', 1), ''), nullif(regexp_extract(lower(carga_horaria), '([0-9]+)', 1), '')) AS INT) AS h))"
# the shapes that the derived registry holds: 'ABC - faculdade de x', 'FACULDADE DE X', 'Faculdade de X LTDA', '(ABC) faculdade de x'
_PLAIN = "trim(regexp_replace(faculdade, '\\bLTDA\\b\\.?', '', 'g'))"
_NAME = f"regexp_replace(regexp_replace({_PLAIN}, '^[A-Z0-9]{{2,8}} - ', ''), '^\\([A-Z0-9]+\\) ', '')"
_SHORT = f"regexp_extract({_PLAIN}, '^\\(?([A-Z0-9]{{2,8}})(?: - |\\) )', 1)"
_LAST = f"split_part({_NAME}, ' ', 3)"
INSTITUTION = f"CASE WHEN {BLANK.format('faculdade')} OR lower(faculdade) = 'n/a' THEN NULL ELSE 'Faculdade de ' || upper(substr({_LAST}, 1, 1)) || lower(substr({_LAST}, 2)) || CASE WHEN {_SHORT} <> '' THEN ' (' || {_SHORT} || ')' ELSE '' END END"

REG = f"""WITH reg AS MATERIALIZED ({REGISTRY_SQL}),
e AS MATERIALIZED (SELECT *, {valor("valor_monetario")} AS valor, coalesce(nullif(tipo_documento, ''), 'Não identificado') AS classe, coalesce(status_conferencia, 'pendente') AS conferencia, coalesce(dominio, 'outro') AS dom FROM reg)
"""
PAG = f"WITH pag AS MATERIALIZED ({PAGES_SQL})\n"


def pct(a: str, b: str = "count(*)") -> str:
    return f"round({a} * 100.0 / {b}, 1)"


BRACKET = "CASE WHEN valor <= 0 THEN 4 WHEN valor <= 1000 THEN 0 WHEN valor <= 10000 THEN 1 WHEN valor <= 100000 THEN 2 ELSE 3 END"
HIGH = "(metodo_leitura = 'texto_digital' OR conferencia = 'aprovado')"
LOW = "(erro IS NOT NULL OR classe IN ('Não identificado', 'Desconhecido'))"
BRL = "'R$ ' || replace(replace(replace(format('{{:,.2f}}', {0}), ',', 'X'), '.', ','), 'X', '.')"

SQL: dict[str, str] = {
    "kpis": REG + "SELECT count(*) AS documentos, count(*) FILTER (valor > 0) AS com_valor, round(coalesce(sum(valor), 0), 2) AS total, round(coalesce(avg(valor) FILTER (valor > 0), 0), 2) AS ticket_medio, round(coalesce(max(valor), 0), 2) AS maior FROM e",
    "class_distribution": REG + "SELECT classe, count(*) AS documentos, round(sum(valor), 2) AS valor_total FROM e GROUP BY 1",
    "top_classes": REG + "SELECT classe, count(*) AS documentos, round(sum(valor), 2) AS valor_total FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "value_counts": REG + "SELECT 'status_conferencia' AS grupo, conferencia AS valor, count(*) AS documentos FROM e GROUP BY 2 UNION ALL SELECT 'dominio', dom, count(*) FROM e GROUP BY 2",
    "preponderant_domain": REG + f"SELECT dominio, documentos, {pct('documentos', 't')} AS percentual, {pct('documentos', 't')} >= 50.0 AS eh_maioria FROM (SELECT dom AS dominio, count(*) AS documentos, (SELECT count(*) FROM e) AS t, min(md5) AS f FROM e GROUP BY 1 ORDER BY 2 DESC, f LIMIT 1)",
    "flag_counts": REG + "SELECT count(*) FILTER (tem_assinatura_digital) AS tem_assinatura_digital, count(*) FILTER (eh_nativo_digital) AS eh_nativo_digital, count(duplicata_de) AS duplicatas FROM e",
    "value_brackets": REG + f"SELECT faixa, rotulo, count(f) AS documentos, round(coalesce(sum(valor), 0), 2) AS valor_total FROM (VALUES (0, 'Até R$ 1.000'), (1, 'R$ 1.000 a 10.000'), (2, 'R$ 10.000 a 100.000'), (3, 'Acima de R$ 100.000'), (4, 'Sem Valor Declarado')) t(faixa, rotulo) LEFT JOIN (SELECT {BRACKET} AS f, valor FROM e) ON f = faixa GROUP BY 1, 2",
    "distinct_entities": REG + "SELECT count(DISTINCT cpf) AS cpfs, count(DISTINCT cnpj) AS cnpjs, count(DISTINCT beneficiario) AS beneficiarios FROM e",
    "distinct_valid_entities": REG + f"SELECT count(DISTINCT {DIGITS.format('cpf')}) FILTER ({valid('cpf', 11)}) AS cpfs, count(DISTINCT {DIGITS.format('cnpj')}) FILTER ({valid('cnpj', 14)}) AS cnpjs, count(DISTINCT lower(trim(beneficiario))) FILTER (length(trim(beneficiario)) >= 3) AS beneficiarios FROM e",
    "top_holders": REG + "SELECT nome, documentos, valor_total FROM (SELECT coalesce(beneficiario, 'CPF ' || cpf) AS nome, count(*) AS documentos, round(sum(valor), 2) AS valor_total, min(md5) AS f FROM e WHERE coalesce(beneficiario, cpf) IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, f LIMIT 10)",
    "temporal_distribution": REG + f"SELECT CASE WHEN coalesce(data, '') IN ('', '-') THEN 'Sem Data' ELSE coalesce({year('data')}::VARCHAR, 'Indeterminado') END AS ano, count(*) AS documentos, round(sum(valor), 2) AS valor_total FROM e GROUP BY 1",
    "reliability_tiers": REG + f"SELECT count(*) FILTER (NOT {LOW} AND {HIGH}) AS alta, count(*) FILTER (NOT {LOW} AND NOT {HIGH}) AS media, count(*) FILTER ({LOW}) AS baixa FROM e",
    "metadata_quality": REG + f"SELECT {pct('count(*) FILTER (coalesce(cpf, cnpj) IS NOT NULL)')} AS pct_cpf_cnpj, {pct('count(*) FILTER (valor > 0)')} AS pct_valor, {pct("count(*) FILTER (data <> '-')")} AS pct_data, {pct('count(beneficiario)')} AS pct_beneficiario, {pct('count(*) FILTER (tem_assinatura_digital)')} AS pct_assinado, {pct("count(*) FILTER (conferencia = 'aprovado')")} AS pct_aprovado FROM e",
    "domain_chart": REG + "SELECT t.dominio, count(x.d) AS documentos FROM (VALUES ('financeiro'), ('juridico'), ('identificacao'), ('cadastral'), ('academico'), ('veicular'), ('outro')) t(dominio) LEFT JOIN (SELECT CASE WHEN dom = 'profissional' THEN 'cadastral' ELSE dom END AS d FROM e) x ON x.d = t.dominio GROUP BY 1",
    "type_top7_rest": REG + "SELECT CASE WHEN r <= 7 THEN tipo ELSE 'Outros Subtipos' END AS tipo, sum(n)::BIGINT AS documentos FROM (SELECT tipo, n, row_number() OVER (ORDER BY n DESC, f) AS r FROM (SELECT coalesce(tipo_documento, 'Não especificado') AS tipo, count(*) AS n, min(md5) AS f FROM e GROUP BY 1)) GROUP BY 1",
    "level_chart": REG + f"SELECT {LEVEL} AS nivel, count(*) AS documentos FROM e GROUP BY 1",
    "hours_buckets": REG + f"SELECT CASE WHEN h IS NULL THEN 'Não informada' WHEN h < 40 THEN '< 40h (Curta Duração)' WHEN h < 180 THEN '40h a 179h (Extensão)' WHEN h < 360 THEN '180h a 359h (Capacitação)' WHEN h < 1000 THEN '360h a 999h (Especialização/MBA)' ELSE '≥ 1000h (Graduação/Técnico)' END AS faixa, count(*) AS documentos FROM (SELECT {HOURS} AS h FROM e) GROUP BY 1",
    "timeline": REG + f"SELECT ano, count(*) AS documentos, round(sum(valor), 2) AS valor_total FROM (SELECT {year('data')} AS ano, valor FROM e) WHERE ano BETWEEN 1970 AND 2035 GROUP BY 1",
    "top_institutions": REG + f"SELECT instituicao, count(*) AS documentos FROM (SELECT {INSTITUTION} AS instituicao FROM e) WHERE instituicao IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_people": REG + "SELECT beneficiario AS nome, count(*) AS documentos FROM e WHERE length(beneficiario) >= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "funnel": REG + f"SELECT {pct('count(*) FILTER (eh_nativo_digital)')} AS nativos, {pct("count(*) FILTER (status <> 'erro')")} AS com_texto, {pct(f'count(*) FILTER ({HIGH})')} AS alta_confiabilidade, {pct("count(*) FILTER (conferencia = 'aprovado')")} AS aprovados FROM e",
    "pivot_domain_review": REG + f"SELECT coalesce(dom, 'Total') AS dominio, coalesce(conferencia, 'Total') AS estado, count(*) AS documentos, {pct('count(*)', '(SELECT count(*) FROM e)')} AS percentual FROM e GROUP BY CUBE (dom, conferencia)",
    "pivot_class_bracket": REG + "SELECT classe, " + ", ".join(f"count(*) FILTER (f = {i}) AS faixa_{i}" for i in range(5)) + f", count(*) AS total FROM (SELECT classe, {BRACKET} AS f FROM e) WHERE classe IN (SELECT classe FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) GROUP BY 1",
    "pivot_level_type": REG + f"SELECT nivel, count(*) FILTER (k = 'd') AS diploma, count(*) FILTER (k = 'c') AS certificado, count(*) FILTER (k = 'h') AS historico, count(*) FILTER (k = 'l') AS declaracao, count(*) FILTER (k = 'o') AS outro, count(*) AS total FROM (SELECT {LEVEL} AS nivel, CASE WHEN t LIKE '%diploma%' THEN 'd' WHEN t LIKE '%certificado%' THEN 'c' WHEN t LIKE '%historico%' THEN 'h' WHEN t LIKE '%declaracao%' OR t LIKE '%atestado%' THEN 'l' ELSE 'o' END AS k FROM (SELECT *, {FOLD.format('tipo_documento')} AS t FROM e)) GROUP BY 1",
    "institution_unify": REG + f"SELECT *, distintos_antes - distintos_depois AS reducao FROM (SELECT count(*) FILTER (faculdade <> n) AS alterados, count(DISTINCT faculdade) AS distintos_antes, count(DISTINCT coalesce(n, faculdade)) AS distintos_depois FROM (SELECT faculdade, {INSTITUTION} AS n FROM e))",
    "institution_samples": REG + f"SELECT DISTINCT faculdade AS de, n AS para FROM (SELECT faculdade, {INSTITUTION} AS n FROM e) WHERE faculdade <> n ORDER BY 1 LIMIT 15",
    "run_summary": REG + "SELECT count(*) AS total, count(*) FILTER (status_conferencia = 'aprovado') AS ja_conferidos, count(*) FILTER (status = 'sucesso') AS sucessos, count(*) FILTER (status = 'erro') AS erros, count(*) FILTER (status NOT IN ('sucesso', 'erro')) AS pendentes FROM e",
    "corpus_counters": REG + "SELECT count(*) FILTER (coalesce(dominio, 'academico') = 'academico') AS academicos, count(*) FILTER (dominio = 'financeiro') AS financeiros, count(*) FILTER (coalesce(dominio, 'academico') NOT IN ('academico', 'financeiro')) AS outros FROM e",
    "bi_csv": REG + f"SELECT 'Domínio' AS secao, dom AS categoria, count(*) AS documentos, {pct('count(*)', '(SELECT count(*) FROM e)')} AS percentual, round(sum(valor), 2) AS valor FROM e GROUP BY 2 UNION ALL SELECT 'Tipo', classe, count(*), {pct('count(*)', '(SELECT count(*) FROM e)')}, round(sum(valor), 2) FROM e GROUP BY 2",
    "bi_summary": REG + f"SELECT 0 AS ordem, 'Documentos: ' || count(*) || ' | Com valor: ' || count(*) FILTER (valor > 0) || ' | Total: ' || {BRL.format('round(sum(valor::DECIMAL(28, 6))::DOUBLE, 2)')} || ' | Ticket: ' || {BRL.format('round((sum(valor::DECIMAL(28, 6)) FILTER (valor > 0))::DOUBLE / (count(*) FILTER (valor > 0)), 2)')} AS linha FROM e UNION ALL SELECT 1, dom || ': ' || count(*) FROM e GROUP BY dom UNION ALL (SELECT 2, classe || ': ' || n FROM (SELECT classe, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15))",
}


def cascade(text: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{'|'.join(w.replace('.', chr(92) + '.') for w in words)}') THEN '{label}'" for words, label in table) + f" ELSE {default} END"


def masked(c: str, size: int, pieces: list[str]) -> str:
    d = DIGITS.format(c)
    return f"CASE WHEN coalesce({c}, '') = '' THEN NULL WHEN length({d}) = {size} THEN {' || '.join(p.format(d=d) for p in pieces)} ELSE trim({c}) END"


CPF_MASK = ["substr({d}, 1, 3) || '.'", "substr({d}, 4, 3) || '.'", "substr({d}, 7, 3) || '-'", "substr({d}, 10, 2)"]
CNPJ_MASK = ["substr({d}, 1, 2) || '.'", "substr({d}, 3, 3) || '.'", "substr({d}, 6, 3) || '/'", "substr({d}, 9, 4) || '-'", "substr({d}, 13, 2)"]
_T = "lower(coalesce(tipo_documento, ''))"
RULE_DOMAIN = cascade("{0}", [(w, d) for w, d in C.RULE_DOMAINS], "'academico'")
DEFAULT_DOMAIN = f"CASE WHEN regexp_matches({_T}, '{'|'.join(C.VEHICLE)}') THEN 'veicular' WHEN NOT regexp_matches({_T}, '{'|'.join(C.NOT_FINANCIAL)}') AND (regexp_matches({_T}, '{'|'.join(C.FINANCIAL)}') OR NOT {BLANK.format('valor_monetario')}) THEN 'financeiro' WHEN regexp_matches({_T}, '{'|'.join(C.PROFESSIONAL)}') THEN 'profissional' WHEN regexp_matches({_T}, '{'|'.join(C.PERSONAL)}') THEN 'identificacao' WHEN regexp_matches({_T}, '{'|'.join(C.LEGAL)}') THEN 'juridico' ELSE 'academico' END"
FORMAT = "CASE WHEN coalesce(lower(extensao), '') = '.docx' OR lower(nome_arquivo) LIKE '%.docx' THEN 'word' WHEN coalesce(lower(extensao), '') = '.png' OR lower(nome_arquivo) LIKE '%.png' THEN 'image' WHEN coalesce(lower(extensao), '') = '.txt' OR lower(nome_arquivo) LIKE '%.txt' THEN 'text' ELSE 'pdf' END"
_UNPAID = f"({BLANK.format('valor_monetario')} AND {BLANK.format('beneficiario')} AND coalesce(dados_extras->>'pix_chave', '') = '')"
UNPROCESSED = f"(status <> 'sucesso' OR CASE WHEN dominio = 'financeiro' THEN {_UNPAID} WHEN coalesce(dominio, 'academico') <> 'academico' THEN {BLANK.format('beneficiario')} AND {BLANK.format('tipo_documento')} ELSE {BLANK.format('beneficiario')} AND {BLANK.format('curso')} END)"
BUCKET = f"CASE WHEN {UNPROCESSED} THEN 'nao_processado' WHEN status_conferencia = 'aprovado' THEN 'aprovado' ELSE 'pendente' END"
# the listed classes of the derived registry repeat a main class only in 'recibo' and in equal spelling
LISTED = "[x for x in string_split(coalesce(todos_tipos_texto, ''), ', ') if lower(x) NOT IN ('', 'documento')]"
TYPES = f"(SELECT CASE WHEN len(t) = 0 THEN ['Não identificado'] ELSE t END FROM (SELECT CASE WHEN tipo_documento IS NULL THEN {LISTED} ELSE [tipo_documento] || [x for x in {LISTED} if lower(x) <> lower(tipo_documento)] END AS t))"
TYP = REG + f", t AS MATERIALIZED (SELECT *, {TYPES} AS tipos FROM e)\n"
_DOMS = f"list_distinct([coalesce(dominio, 'academico')] || [{RULE_DOMAIN.format('lower(x)')} for x in tipos])"
BLOB = "strip_accents(lower(concat_ws(' ', nome_arquivo, tipo_documento, beneficiario, cpf, rg, cnpj, curso, natureza_curso, faculdade, valor_monetario, data, dominio, status, dados_extras)))"
IDS = "concat_ws(' ', " + ", ".join(DIGITS.format(c) for c in ("cpf", "rg", "cnpj")) + ")"


def macro(tag: str) -> str:
    domains, found = C.MACROS[tag]
    some = f"len([x for x in tipos if regexp_matches(strip_accents(lower(x)), '{'|'.join(found)}')]) > 0"
    own = f"coalesce(dominio, '') IN ({', '.join(repr(d) for d in domains)})"
    return f"({own} OR {some}" + (f" OR NOT {BLANK.format('cnpj')})" if tag == "profissional" else ")")


def facet_sql() -> str:
    sel = {"dominio": "list_has_any(f_dominio, ['academico', 'financeiro'])", "status": "list_has_any(f_status, ['pendente'])", "formato": "list_has_any(f_formato, ['pdf', 'word'])", "natureza": "list_has_any(f_natureza, ['Nada'])"}
    macros = "[x for x in [" + ", ".join(f"CASE WHEN {macro(t)} THEN '{t}' END" for t in C.MACROS) + "] if x IS NOT NULL]"
    cols = {"instituicao": f"[x for x in [{INSTITUTION}] if x IS NOT NULL]", "natureza": f"[{LEVEL}]", "tipo": "tipos", "macro": macros, "dominio": _DOMS, "status": f"[{BUCKET}]", "formato": f"[{FORMAT}]"}
    rows = "SELECT " + ", ".join(f"{v} AS f_{k}" for k, v in cols.items()) + " FROM t"
    parts = []
    for f in cols:
        ok = " AND ".join(c for k, c in sel.items() if k != f)
        parts.append(f"SELECT '{f}' AS faceta, valor, count(*) FILTER (ok) AS documentos FROM (SELECT unnest(list_distinct(f_{f})) AS valor, {ok} AS ok FROM r) GROUP BY 2")
    chosen = "(VALUES ('dominio', 'academico'), ('dominio', 'financeiro'), ('status', 'pendente'), ('formato', 'pdf'), ('formato', 'word'), ('natureza', 'Nada')) s(faceta, valor)"
    return TYP + f", r AS MATERIALIZED ({rows}), c AS ({' UNION ALL '.join(parts)}) SELECT faceta, valor, coalesce(documentos, 0) AS documentos FROM c FULL JOIN (SELECT *, true AS chosen FROM {chosen}) s USING (faceta, valor) WHERE documentos > 0 OR chosen"


_ACAD = f"(coalesce(dominio, '') = 'academico' OR regexp_matches({_T}, 'diploma|certificado|histórico|historico|declaração|declaracao'))"
_FIN = f"(coalesce(dominio, '') = 'financeiro' OR regexp_matches({_T}, 'comprovante|pagamento|recibo|nota fiscal|extrato'))"
_HAND = "regexp_matches(lower(concat_ws(' ', tipo_documento, array_to_string(tipos, ' '))), 'manuscrito|manual|mão|mao')"
REASON = f"CASE WHEN status = 'erro' THEN 'falha_leitura_local (' || coalesce(erro, 'erro_leitura') || ')' WHEN tipo_documento IS NULL THEN 'tipo_documento_inconclusivo' WHEN {_HAND} AND beneficiario IS NULL AND valor_monetario IS NULL AND curso IS NULL AND dados_extras->>'emitente' IS NULL THEN 'manuscrito_incompleto' WHEN {_ACAD} AND beneficiario IS NULL THEN 'beneficiario_ausente' WHEN {_ACAD} AND curso IS NULL AND faculdade IS NULL THEN 'dados_academicos_essenciais_ausentes' WHEN NOT {_ACAD} AND {_FIN} AND valor_monetario IS NULL AND beneficiario IS NULL THEN 'dados_financeiros_essenciais_ausentes' ELSE 'nenhum' END"
_ACTIVE = "dominio tipo_documento beneficiario cpf rg cnpj curso natureza_curso carga_horaria faculdade valor_monetario data endereco_completo fonte_pagadora vendedor razao_social".split()
_NULL_LIKE = "('', 'null', 'none', 'n/a', '-', 'não informado', 'nao informado', 'undefined')"

SQL |= {
    "cpf_validation": REG + f"SELECT md5, {masked('cpf', 11, CPF_MASK)} AS cpf, coalesce({valid('cpf', 11)}, false) AS valido, coalesce({valid('cpf', 11)} AND regexp_full_match(cpf, '[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}}'), false) AS estrito FROM e",
    "cnpj_validation": REG + f"SELECT md5, {masked('cnpj', 14, CNPJ_MASK)} AS cnpj, coalesce({valid('cnpj', 14)}, false) AS valido FROM e",
    "money_parse": REG + f"SELECT md5, valor, {BRL.format('valor')} AS texto FROM e",
    "year_extract": REG + f"SELECT md5, {year('data')} AS ano FROM e",
    "hours_extract": REG + f"SELECT md5, {HOURS} AS horas FROM e",
    "fold_text": REG + f"SELECT md5, {FOLD.format('tipo_documento')} AS tipo, {FOLD.format('faculdade')} AS faculdade FROM e",
    "path_parts": REG + "SELECT md5, coalesce(beneficiario, 'Nao_Informado') AS parte FROM e",
    "institution_names": REG + f"SELECT md5, {INSTITUTION} AS instituicao FROM e",
    "rule_domains": REG + f"SELECT md5, {RULE_DOMAIN.format(_T)} AS dominio FROM e",
    "default_domains": REG + f"SELECT md5, {DEFAULT_DOMAIN} AS dominio FROM e",
    "format_classes": REG + f"SELECT md5, {FORMAT} AS formato FROM e",
    "tag_categories": REG + f"SELECT tipo_documento, count(*) AS documentos, CASE WHEN tipo_documento IS NULL THEN 'Outros' ELSE {cascade(FOLD.format('tipo_documento'), C.CATEGORIES, repr('Outros'))} END AS categoria FROM e GROUP BY 1",
    "type_sets": TYP + "SELECT md5, array_to_string(tipos, '|') AS tipos FROM t",
    "point_lookup": REG + "SELECT md5, nome_arquivo FROM e WHERE md5 = 'c4ca4238a0b923820dcc509a6f75849b'",
    "unprocessed": REG + f"SELECT md5, {UNPROCESSED} AS nao_processado FROM e",
    "review_buckets": REG + f"SELECT {BUCKET} AS situacao, count(*) AS documentos, count(*) FILTER (contains(todos_tipos_texto, ',')) AS dossies FROM e GROUP BY 1",
    "token_search": REG + f"SELECT md5 FROM e WHERE contains({BLOB}, 'diploma') AND (contains({BLOB}, '2024') OR contains({IDS}, '2024'))",
    "token_search_ids": REG + f"SELECT md5 FROM e WHERE contains({BLOB}, 'certificado') AND (contains({BLOB}, '05-03') OR contains({IDS}, '0503'))",
    "domain_filter": TYP + f"SELECT md5 FROM t WHERE list_contains({_DOMS}, 'financeiro')",
    "quick_view_pending": REG + f"SELECT md5 FROM e WHERE {BUCKET} = 'pendente'",
    "macro_tags": TYP + "SELECT " + ", ".join(f"count(*) FILTER ({macro(t)}) AS {t}" for t in C.MACROS) + " FROM t",
    "facet_counts": facet_sql(),
    "escalation_reasons": TYP + f"SELECT {REASON} AS motivo, count(*) AS documentos FROM t GROUP BY 1",
    "subtags": REG + f"SELECT md5, CASE WHEN dominio = 'financeiro' THEN concat_ws('|', valor_monetario, dados_extras->>'pix_chave') WHEN dominio = 'veicular' THEN '' WHEN dominio = 'profissional' THEN coalesce({masked('cnpj', 14, CNPJ_MASK)}, '') WHEN dominio = 'identificacao' THEN concat_ws('|', {masked('cpf', 11, CPF_MASK)}, rg) WHEN dominio = 'juridico' THEN concat_ws('|', beneficiario, vendedor) ELSE concat_ws('|', curso, {INSTITUTION}) END AS etiquetas FROM e",
    "final_status": REG + "SELECT md5, CASE WHEN coalesce(tipo_documento, beneficiario, cpf, rg, cnpj, curso, faculdade, valor_monetario, data, carga_horaria, natureza_curso) IS NOT NULL THEN 'sucesso' ELSE 'erro' END AS status, CASE WHEN coalesce(tipo_documento, beneficiario, cpf, rg, cnpj, curso, faculdade, valor_monetario, data, carga_horaria, natureza_curso) IS NULL THEN 'Nenhum dado útil extraído' END AS mensagem FROM e",
    "scope_classified": REG + "SELECT count(*) AS documentos, count(*) FILTER (valor > 0) AS com_valor, round(coalesce(sum(valor), 0), 2) AS total, round(coalesce(avg(valor) FILTER (valor > 0), 0), 2) AS ticket_medio, round(coalesce(max(valor), 0), 2) AS maior FROM e WHERE status = 'sucesso' AND tipo_documento IS NOT NULL AND dominio = 'financeiro'",
    "active_fields": REG + "SELECT chave, count(*) AS documentos FROM (" + " UNION ALL ".join([f"SELECT '{c}' AS chave, {c} AS valor FROM e" for c in _ACTIVE] + [f"SELECT '{k}', dados_extras->>'{k}' FROM e" for k in ("pix_chave", "emitente", "n")]) + f") WHERE lower(trim(coalesce(valor, ''))) NOT IN {_NULL_LIKE} GROUP BY 1",
    "gallery_page": REG + "SELECT md5, data FROM e ORDER BY coalesce(data, data_modificacao, '') DESC, md5 LIMIT 50 OFFSET 20",
    "gallery_pending": REG + f"SELECT md5 FROM e ORDER BY CASE {BUCKET} WHEN 'pendente' THEN 0 WHEN 'nao_processado' THEN 1 ELSE 2 END, md5 LIMIT 50",
    "master_values": TYP + "SELECT DISTINCT 'natureza' AS lista, natureza_curso AS valor FROM t WHERE natureza_curso IS NOT NULL UNION ALL SELECT DISTINCT 'instituicao', faculdade FROM t WHERE faculdade IS NOT NULL UNION ALL SELECT DISTINCT 'tipo', unnest(tipos) FROM t",
}


def squash(name: str) -> str:
    return f"upper(trim(regexp_replace(strip_accents(coalesce({name}, '')), '\\s+', ' ', 'g')))"


_FID = "CASE WHEN length({d}) = 11 THEN {cpf} WHEN length({d}) = 14 THEN {cnpj} END"
CPF_ID, CNPJ_ID = (_FID.format(d=DIGITS.format(c), cpf=masked(c, 11, CPF_MASK), cnpj=masked(c, 14, CNPJ_MASK)) for c in ("cpf", "cnpj"))
DOS = REG + f""", k AS MATERIALIZED (SELECT *, CASE WHEN c IS NOT NULL THEN 'CPF' WHEN j IS NOT NULL THEN 'CNPJ' WHEN beneficiario LIKE '% %' AND length(beneficiario) >= 8 THEN 'NOME' END AS tipo_entidade,
  coalesce(c, j, CASE WHEN beneficiario LIKE '% %' AND length(beneficiario) >= 8 THEN upper(beneficiario) END) AS identificador FROM (SELECT *, {CPF_ID} AS c, {CNPJ_ID} AS j FROM e)),
dos AS (SELECT 'dossie_' || regexp_replace(lower(tipo_entidade || '_' || identificador), '[^a-z0-9_]', '_', 'g') AS id, tipo_entidade, identificador, coalesce(arg_min(beneficiario, md5) FILTER (beneficiario IS NOT NULL), identificador) AS nome_titular, count(*) AS total_documentos FROM k WHERE tipo_entidade IS NOT NULL GROUP BY 2, 3 HAVING count(*) >= 2)
"""
_PF = "CASE WHEN {ok} THEN 'PF_' || {d} WHEN rg IS NOT NULL THEN 'PF_RGNM_' || substr(sha1({n} || '|' || {r}), 1, 16) ELSE 'PF_PROV_' || substr(md5, 1, 16) || '_' || substr(sha1({n}), 1, 8) END".format(ok=valid("cpf", 11), d=DIGITS.format("cpf"), n=squash("beneficiario"), r=DIGITS.format("rg"))


def _loose(c: str) -> str:
    return f"'PF_PROV_' || substr(md5, 1, 16) || '_' || substr(sha1({squash(c)}), 1, 8)"


ENT = REG + f""", r AS MATERIALIZED (
  SELECT md5, 0 AS pos, 'titular' AS papel, 'PF' AS tipo, {_PF} AS id, {squash('beneficiario')} AS nome, CASE WHEN {valid('cpf', 11)} THEN {DIGITS.format('cpf')} ELSE '' END AS cpf,
    CASE WHEN {valid('cpf', 11)} THEN coalesce(rg, '') WHEN rg IS NOT NULL THEN {DIGITS.format('rg')} ELSE '' END AS rg, '' AS cnpj, NOT {valid('cpf', 11)} AND rg IS NULL AS inc FROM e WHERE beneficiario IS NOT NULL
  UNION ALL SELECT md5, 0, 'titular', 'PJ', CASE WHEN {valid('cnpj', 14)} THEN 'PJ_' || {DIGITS.format('cnpj')} ELSE 'PJ_PROV_' || substr(md5, 1, 16) || '_' || substr(sha1({squash('razao_social')}), 1, 8) END, {squash('razao_social')}, '', '', CASE WHEN {valid('cnpj', 14)} THEN {DIGITS.format('cnpj')} ELSE '' END, NOT {valid('cnpj', 14)} FROM e WHERE beneficiario IS NULL AND razao_social IS NOT NULL
  UNION ALL SELECT md5, 1, 'fonte_pagadora', CASE WHEN {valid('cnpj_fonte_pagadora', 14)} THEN 'PJ' ELSE 'PF' END, CASE WHEN {valid('cnpj_fonte_pagadora', 14)} THEN 'PJ_' || {DIGITS.format('cnpj_fonte_pagadora')} ELSE {_loose('fonte_pagadora')} END, {squash('fonte_pagadora')}, '', '', CASE WHEN {valid('cnpj_fonte_pagadora', 14)} THEN cnpj_fonte_pagadora ELSE '' END, NOT {valid('cnpj_fonte_pagadora', 14)} FROM e WHERE fonte_pagadora IS NOT NULL
  UNION ALL SELECT md5, 2, 'emitente', 'PF', {_loose("(dados_extras->>'emitente')")}, {squash("(dados_extras->>'emitente')")}, '', '', '', true FROM e WHERE dados_extras->>'emitente' IS NOT NULL
  UNION ALL SELECT md5, 3, 'vendedor', 'PF', {_loose('vendedor')}, {squash('vendedor')}, '', '', '', true FROM e WHERE vendedor IS NOT NULL),
g AS (SELECT id, tipo, arg_min({{'nome': nome, 'cpf': cpf, 'rg': rg, 'cnpj': cnpj, 'inc': inc}}, md5 || pos) AS f, string_agg(DISTINCT md5, ';' ORDER BY md5) AS documentos_md5 FROM r GROUP BY 1, 2)
"""
_HOLD = "LEFT JOIN (SELECT md5, id, tipo FROM r WHERE papel = 'titular') h USING (md5)"
_S1 = "substr(md5, 1, 1)"
_REQ = "coalesce((e.status = 'erro' AND contains(erro, 'OCR')), false) OR ((lower(coalesce(tipo_documento, '')) IN ('', 'não identificado', 'nao identificado', 'outro', 'não informado', 'nao informado') OR (cpf IS NOT NULL AND NOT {v})) AND NOT coalesce(tentativa_ocr_llm, false))".format(v=valid("cpf", 11))


def plan(again: str, approved: str) -> str:
    return REG + f", f AS (SELECT CASE WHEN {_S1} < '4' THEN md5(reverse(md5)) ELSE md5 END AS md5, 'a/' || nome_arquivo AS caminho FROM e) SELECT f.md5, min(f.caminho) AS caminho, any_value(CASE WHEN e.md5 IS NULL THEN 'novo' WHEN {approved} THEN 'pronto' WHEN {again} THEN 'refazer' ELSE 'pronto' END) AS acao FROM f LEFT JOIN e ON e.md5 = f.md5 GROUP BY 1"


_S2 = "substr(md5, 2, 1)"
_NEWTYPES = "[x for x in tipos if lower(x) <> 'recibo']"
_NEWMAIN = f"CASE WHEN lower(tipo_documento) = 'recibo' THEN coalesce(({_NEWTYPES})[1], 'Outro') ELSE tipo_documento END"
_IS_FIN = f"list_contains([{RULE_DOMAIN.format('lower(coalesce(x, chr(0)))')} for x in {_NEWTYPES} || [{_NEWMAIN}] if x IS NOT NULL], 'financeiro')"
_NOPIX = "[x for x in tipos if NOT contains(lower(x), 'pix')]"
_PIXMAIN = f"CASE WHEN contains(lower(tipo_documento), 'pix') THEN coalesce(({_NOPIX})[1], 'Outro') ELSE tipo_documento END"
_PLACE = FOLD.format("nome_arquivo")
_FOLDTEXT = "regexp_extract_all(strip_accents(lower(trim(coalesce(text, '')))), '[\\p{L}\\p{N}]+')"
IDX = f"WITH tok AS MATERIALIZED (SELECT md5(doc_id::VARCHAR) AS md5, {_FOLDTEXT} AS w FROM documents), post AS MATERIALIZED (SELECT md5, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tok), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM tok)\n"


def bm25(parts: list[str], test: str, negative: tuple[int, ...] = ()) -> str:
    hits = " UNION ALL ".join(f"SELECT {i} AS part, md5, n, count(*) AS tf FROM {p} GROUP BY md5, n" for i, p in enumerate(parts))
    return IDX + f", hits AS MATERIALIZED ({hits}), d AS (SELECT part, count(*) AS df FROM hits GROUP BY 1), s AS (SELECT md5, list(part) AS parts, sum(CASE WHEN part IN ({', '.join(map(str, negative or (-1,)))}) THEN 0 ELSE greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) END) AS s FROM hits JOIN d USING (part), st GROUP BY 1) SELECT md5, round(-s, 6) AS fts_score FROM s WHERE {test} ORDER BY -s, md5 LIMIT 50"


def _word(w: str, prefix: bool) -> str:
    return f"(SELECT * FROM post WHERE {'starts_with(term, ' + repr(w) + ')' if prefix else 'term = ' + repr(w)})"


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RANKS = {f: "CASE dominio " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(ds)) + " END" for f, ds in P.HOLDERS.items()}
_PRIO = "CASE tipo " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(P.PRIORITY)) + " END"
_ACA, _PES, _CHQ = (", ".join(repr(x) for x in xs) for xs in (P.ACADEMIC, P.PERSONAL, P.CHEQUES))


def in_order(c: str) -> str:
    return f"array_to_string(list_distinct(list({c} ORDER BY pagina) FILTER ({c} IS NOT NULL)), '|')"


def first_seen(c: str) -> str:
    """Distinct values by their first page."""
    return f"(SELECT coalesce(string_agg(v, '|' ORDER BY p), '') FROM (SELECT {c} AS v, min(pagina) AS p FROM pag q WHERE q.md5 = d.md5 AND {c} IS NOT NULL GROUP BY 1))"


SQL |= {
    "dossier_clusters": DOS + "SELECT * FROM dos",
    "dossier_documents": DOS + "SELECT id, string_agg(md5, ',' ORDER BY coalesce(data, ''), nome_arquivo, md5) AS documentos FROM dos JOIN k USING (tipo_entidade, identificador) GROUP BY 1",
    "entity_links": ENT + "SELECT md5 AS documento_md5, id AS entidade_id, tipo AS tipo_entidade, papel FROM r",
    "entity_people": ENT + "SELECT id AS entidade_id, f.nome AS nome_normalizado, f.cpf AS cpf, f.rg AS rg, f.inc AS identificacao_incompleta, documentos_md5 FROM g WHERE tipo = 'PF'",
    "entity_companies": ENT + "SELECT id AS entidade_id, f.nome AS razao_social_normalizada, f.cnpj AS cnpj, f.inc AS identificacao_incompleta, documentos_md5 FROM g WHERE tipo = 'PJ'",
    "entity_addresses": ENT + f"SELECT h.id AS entidade_id, h.tipo AS tipo_entidade, md5 AS documento_md5, endereco_completo FROM e {_HOLD} WHERE endereco_completo IS NOT NULL AND h.id IS NOT NULL",
    "entity_documents": ENT + f"SELECT md5, nome_arquivo, coalesce(tipo_documento, '') AS tipo_documento, coalesce(data, '') AS data, coalesce(h.id, '') AS entidade_titular_id, status, coalesce(status_conferencia, '') AS status_conferencia FROM e {_HOLD}",
    "archive_names": REG + "SELECT md5, CASE WHEN r = 1 THEN n || '.pdf' ELSE n || '_' || substr(md5, 1, 6) || '_' || (r - 1) || '.pdf' END AS membro FROM (SELECT md5, coalesce(tipo_documento, 'sem') AS n, row_number() OVER (PARTITION BY coalesce(tipo_documento, 'sem') ORDER BY md5) AS r FROM e)",
    "incremental_plan": plan("e.status <> 'sucesso'", "e.status_conferencia = 'aprovado'"),
    "reprocess_plan": plan(_REQ, "e.status_conferencia = 'aprovado'"),
    "force_plan": "SELECT acao, count(*) AS documentos FROM (" + plan("true", "false") + ") GROUP BY 1",
    "upsert_merge": REG + f""", o AS (SELECT * FROM e WHERE {_S1} < 'c'), n AS (SELECT md5, nome_arquivo, CASE WHEN {_S2} = 'f' THEN tipo_documento END AS tipo_documento, CASE WHEN {_S2} < '8' THEN 'Novo Titular' END AS beneficiario, cpf, CASE WHEN {_S2} >= 'c' THEN 'R$ 1,00' END AS valor_monetario, faculdade, 'sucesso' AS status, status_conferencia FROM e WHERE {_S1} >= '8')
SELECT coalesce(o.md5, n.md5) AS md5, coalesce(n.nome_arquivo, o.nome_arquivo) AS nome_arquivo, CASE WHEN n.md5 IS NULL THEN o.tipo_documento ELSE n.tipo_documento END AS tipo_documento, coalesce(n.beneficiario, o.beneficiario) AS beneficiario, coalesce(n.cpf, o.cpf) AS cpf, coalesce(n.valor_monetario, o.valor_monetario) AS valor_monetario, coalesce(n.faculdade, o.faculdade) AS faculdade, coalesce(n.status, o.status) AS status, CASE WHEN n.md5 IS NULL THEN o.status_conferencia ELSE n.status_conferencia END AS status_conferencia FROM o FULL JOIN n ON o.md5 = n.md5""",
    "review_update": REG + "SELECT md5, nome_arquivo, tipo_documento, beneficiario, cpf, valor_monetario, faculdade, status, CASE WHEN substr(md5, 1, 2) < '20' THEN 'aprovado' ELSE status_conferencia END AS status_conferencia FROM e",
    "bulk_retag": REG + "SELECT md5, CASE WHEN substr(md5, 1, 2) < '20' THEN 'Diploma' ELSE tipo_documento END AS tipo_documento, CASE WHEN substr(md5, 1, 2) < '20' THEN 'academico' ELSE dominio END AS dominio, CASE WHEN substr(md5, 1, 2) < '20' THEN 'Faculdade Nova (ABC)' ELSE faculdade END AS faculdade FROM e",
    "preserved_review": REG + "SELECT md5, status_conferencia FROM e",
    "unified_registry": REG + f"SELECT md5, coalesce({INSTITUTION}, faculdade) AS faculdade FROM e",
    "registry_reconcile": REG + f"SELECT md5, nome_arquivo, tipo_documento, beneficiario, cpf, valor_monetario, faculdade, status, status_conferencia FROM e",
    "placeholders": REG + "SELECT md5, coalesce(tipo_documento, 'sem nome') || '.pdf' AS nome_arquivo, CASE WHEN tipo_documento IN ('Comprovante PIX', 'Recibo', 'Boleto Bancário') THEN 'financeiro' ELSE 'academico' END AS dominio, 'nao_processado' AS status, 'pendente' AS status_conferencia FROM e WHERE NOT eh_nativo_digital",
    "type_removed": TYP + f"SELECT md5, {_NEWMAIN} AS tipo_documento, CASE WHEN dominio = 'financeiro' AND NOT {_IS_FIN} THEN {RULE_DOMAIN.format(f'lower(coalesce({_NEWMAIN}, chr(0)))')} ELSE dominio END AS dominio, array_to_string({_NEWTYPES}, '|') AS tipos FROM t",
    "pix_removed": TYP + f"SELECT md5, {_PIXMAIN} AS tipo_documento, {RULE_DOMAIN.format(f'lower(coalesce({_PIXMAIN}, chr(0)))')} AS dominio FROM t",
    "type_added": TYP + "SELECT md5, array_to_string(CASE WHEN list_contains(tipos, 'RG') THEN tipos ELSE list_append(tipos, 'RG') END, '|') AS tipos FROM t",
    "duplicate_fields": REG + ", p AS (SELECT a.md5 AS canonico_md5, b.md5 AS duplicata_md5, a, b FROM e b JOIN e a ON a.md5 = b.duplicata_de) " + " UNION ALL ".join(f"SELECT canonico_md5, duplicata_md5, '{c}' AS campo, CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 'nao_comparavel' WHEN lower(a.{c}) = lower(b.{c}) THEN 'igual' ELSE 'difere' END AS resultado FROM p" for c in ("tipo_documento", "dominio", "cpf", "rg", "cnpj", "beneficiario", "curso", "natureza_curso", "carga_horaria", "faculdade", "valor_monetario", "data")),
    # pages one by one, with the class that the page before left behind
    "contract_carry": PAG.replace("WITH", "WITH RECURSIVE", 1) + """, walk AS (SELECT md5, pagina, tipo, tipo AS state FROM pag WHERE pagina = 1
  UNION ALL SELECT p.md5, p.pagina, CASE WHEN p.tipo IS NULL AND w.state LIKE 'Contrato%' AND contains(p.texto, 'clausula') THEN w.state ELSE p.tipo END, coalesce(p.tipo, w.state) FROM walk w JOIN pag p ON p.md5 = w.md5 AND p.pagina = w.pagina + 1)
SELECT md5, pagina, tipo FROM walk""",
    "return_merge": PAG + f"SELECT md5, pagina, CASE WHEN tipo = '{P.RETURN}' AND max((tipo = '{P.RECEIPT}')::INT) OVER (PARTITION BY md5) = 1 THEN '{P.RECEIPT}' ELSE tipo END AS tipo FROM pag",
    "holder_by_priority": PAG + "SELECT md5, " + ", ".join(f"arg_min({f}, ({r}) * 100000 + pagina) FILTER ({f} IS NOT NULL AND ({r}) IS NOT NULL) AS {f}" for f, r in _RANKS.items()) + " FROM pag GROUP BY 1",
    "principal_type": PAG + f""", a AS (SELECT md5, count(*) AS n, count(*) FILTER (tipo IN ({_CHQ})) AS c, count(DISTINCT numero_cheque) AS nc, count(*) FILTER (tipo IN ({_ACA})) AS aca, count(*) FILTER (tipo IN ({_PES})) AS pes,
  count(*) FILTER (dominio = 'veicular') AS v, count(DISTINCT tipo) FILTER (dominio = 'veicular') AS vt, arg_min(tipo, pagina) FILTER (dominio = 'veicular') AS carro, arg_min(tipo, ({_PRIO}) * 100000 + pagina) FILTER (tipo IS NOT NULL) AS tp, arg_min(dominio, ({_PRIO}) * 100000 + pagina) FILTER (tipo IS NOT NULL) AS dp, max(CASE WHEN dominio = 'academico' THEN dominio END) AS acad, arg_min(dominio, pagina) AS d1 FROM pag GROUP BY 1),
  x AS (SELECT *, (c >= 2 OR nc >= 2 OR (c >= 1 AND n > 1 AND c / n >= 0.5)) AND aca = 0 AS book, aca = 0 AND pes = 0 AS plain FROM a)
SELECT md5, CASE WHEN book THEN 'Talão de Cheques' WHEN c = 1 AND plain THEN 'Folha de Cheque' WHEN v >= 2 AND vt >= 2 AND aca = 0 THEN 'Dossiê Veicular' WHEN v >= 1 AND plain THEN carro ELSE tp END AS tipo_principal,
  CASE WHEN book OR (c = 1 AND plain) THEN 'financeiro' WHEN (v >= 2 AND vt >= 2 AND aca = 0) OR (v >= 1 AND plain) THEN 'veicular' ELSE coalesce(dp, acad, d1, 'academico') END AS dominio_principal FROM x""",
    "page_types_ordered": PAG + f"SELECT md5, {first_seen('tipo')} AS tipos, {first_seen('dominio')} AS dominios FROM (SELECT DISTINCT md5 FROM pag) d",
    "first_page_values": PAG + f"SELECT md5, (SELECT arg_min(cpf, pagina) FILTER (cpf IS NOT NULL) FROM pag q WHERE q.md5 = d.md5) AS cpf, (SELECT arg_min(cnpj, pagina) FILTER (cnpj IS NOT NULL) FROM pag q WHERE q.md5 = d.md5) AS cnpj, {first_seen('numero_cheque')} AS numeros_cheque FROM (SELECT DISTINCT md5 FROM pag) d",
    "postings_stats": IDX + "SELECT term, count(DISTINCT md5) AS df, count(*) AS cf FROM post GROUP BY 1",
    "bm25_search": bm25([_word("stupid", True), _word("idiot", True)], "len(parts) = 2"),
    "bm25_boolean": bm25([_word("stupid", False), _word("idiot", False), _word("trash", False)], "list_contains(parts, 0) AND list_contains(parts, 1) AND NOT list_contains(parts, 2)", (2,)),
    "search_snippets": "WITH best AS (" + bm25([_word(w, False) for w in ("stupid", "idiot", "trash")], "true") + r"""),
raw AS (SELECT md5(doc_id::VARCHAR) AS md5, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS raw FROM documents),
hit AS (SELECT md5, i, q FROM (SELECT md5, unnest(raw) AS w, generate_subscripts(raw, 1) - 1 AS i FROM raw SEMI JOIN best USING (md5)), (VALUES ('stupid'), ('idiot'), ('trash')) v(q) WHERE list_contains(regexp_extract_all(strip_accents(lower(w)), '[\p{L}\p{N}]+'), q)),
win AS (SELECT a.md5, a.i, count(DISTINCT b.q) AS words, count(*) AS n, max(b.i) AS last FROM (SELECT DISTINCT md5, i FROM hit) a JOIN hit b ON a.md5 = b.md5 AND b.i BETWEEN a.i AND a.i + 14 GROUP BY 1, 2),
top AS (SELECT md5, arg_max(struct_pack(i, last), (words, n, -i)) AS t FROM win GROUP BY 1),
place AS (SELECT md5, raw, greatest(0, least(t.i - floor((15 - (t.last - t.i + 1)) / 2)::BIGINT, len(raw) - 15)) AS s FROM top JOIN raw USING (md5)),
shown AS (SELECT md5, raw, s, list_transform(range(s, least(s + 15, len(raw))), lambda k: CASE WHEN list_contains(places, k) THEN '<mark>' || raw[k + 1] || '</mark>' ELSE raw[k + 1] END) AS w FROM place JOIN (SELECT md5, list(i) AS places FROM hit GROUP BY 1) USING (md5))
SELECT md5, CASE WHEN s > 0 THEN '... ' ELSE '' END || array_to_string(w, ' ') || CASE WHEN len(raw) > s + 15 THEN ' ...' ELSE '' END AS fts_snippet FROM shown""",
    "bm25_phrase": bm25(["(SELECT a.md5, a.n FROM post a JOIN post b ON a.md5 = b.md5 AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')", _word("moron", False)], "true"),
    "compare_normalized": f"SELECT md5(doc_id::VARCHAR) AS md5, md5({_NORM}) AS norm FROM documents",
    "exact_duplicates": "SELECT md5(text) AS chave, count(*) AS documentos, min(md5(doc_id::VARCHAR)) AS primeiro FROM documents GROUP BY 1 HAVING count(*) > 1",
    "highlight_counts": "SELECT md5(doc_id::VARCHAR) AS md5, len(regexp_extract_all(lower(text), 'the'))::BIGINT AS n FROM documents",
}

SQL |= {
    "html_metadata": "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]+)\"', 1), '') AS language, nullif(regexp_extract(html, '(?i)<meta\\s+charset=\"([^\"]+)\"', 1), '') AS charset, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS source FROM pages",
    "rule_longest_match": "WITH r AS (SELECT lower(trim(array_to_string(string_split(text, ' ')[1:5], ' '))) AS t, 'Prova' AS valor_atribuido, item_id AS id FROM benchmark UNION ALL VALUES ('the', 'Inglês', 1001), ('und', 'Alemão', 1002), ('idiot', 'Ofensa', 1003)), x AS (SELECT md5(doc_id::VARCHAR) AS md5, lower(text) AS low FROM documents) SELECT md5, arg_max(id, length(t) * 100000 + id) AS id, arg_max(valor_atribuido, length(t) * 100000 + id) AS valor_atribuido FROM x JOIN r ON contains(low, t) AND (length(t) > 4 OR regexp_matches(low, '(^|[^\\p{L}\\p{N}_])' || t || '([^\\p{L}\\p{N}_]|$)')) GROUP BY 1",
    "consolidated_report": REG + "SELECT 0 AS pos, 'Documentos: ' || count(*) || ' | Com sucesso: ' || count(*) FILTER (status = 'sucesso') AS linha FROM e UNION ALL SELECT pos, concat_ws(' | ', pos, nome_arquivo, coalesce(tipo_documento, '-'), coalesce(beneficiario, '-'), coalesce(CASE WHEN dominio = 'financeiro' THEN valor_monetario ELSE curso END, '-')) FROM (SELECT *, row_number() OVER (ORDER BY md5) AS pos FROM e)",
    # a term of two words stands in a text where a word ends with its first and the next begins with its second, one blank between them
    "rule_match_many": r"""WITH d AS (SELECT md5(doc_id::VARCHAR) AS md5, lower(text) AS low FROM documents),
w AS (SELECT md5, list_filter(regexp_split_to_array(low, '[ \n\r\t]+'), lambda x: x <> '') AS w FROM d),
r AS MATERIALIZED (SELECT t, ('0x' || substr(md5(t), 1, 15))::BIGINT AS id, string_split(t, ' ')[1] AS x FROM (SELECT DISTINCT md5, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM w)
  WHERE length(t) > 4 GROUP BY t HAVING count(*) >= 2),
line AS (SELECT md5, string_split(unnest(regexp_split_to_array(low, '[\n\r\t]')), ' ') AS p FROM d),
near AS MATERIALIZED (SELECT DISTINCT md5, z[1] AS a, z[2] AS b FROM (SELECT md5, unnest(list_zip(p[1:len(p) - 1], p[2:])) AS z FROM line)),
duo AS MATERIALIZED (SELECT DISTINCT a, b FROM near WHERE a <> '' AND b <> ''),
ends AS (SELECT a, b, a[i:] AS x FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM duo) SEMI JOIN (SELECT DISTINCT x FROM r) k ON a[i:] = k.x),
cut AS (SELECT a, b, x || ' ' || b[1:j] AS t FROM (SELECT *, unnest(range(1, length(b) + 1)) AS j FROM ends)),
found AS MATERIALIZED (SELECT a, b, max((length(t), id, t)) AS best FROM cut JOIN r USING (t) GROUP BY a, b),
top AS (SELECT md5, max(best) AS best FROM near JOIN found USING (a, b) GROUP BY md5)
SELECT md5, best[2] AS id, best[3] AS termo_chave, 'Regra ' || substr(md5(best[3]), 1, 2) AS valor_atribuido FROM top""",
    "flat_table": REG + "SELECT " + ", ".join({"beneficiario": "coalesce(beneficiario, '')", "cpf": "coalesce(cpf, '')", "faculdade": "coalesce(faculdade, '')", "tipo_documento": "coalesce(tipo_documento, '')", "status": "coalesce(status, '')",
      "tentativa_ocr_llm": "CASE WHEN tentativa_ocr_llm THEN 'Sim' ELSE 'Não' END", "nome_arquivo": "nome_arquivo", "md5": "md5"}.get(c, "''") + f' AS "{h}"' for c, h in sinks.HEADERS.items())
      + """, CASE WHEN eh_nativo_digital THEN 'Sim' ELSE 'Não' END AS eh_nativo_digital, coalesce(dados_extras->>'emitente', '') AS emitente, coalesce(dados_extras->>'n', '') AS n, coalesce(dados_extras->>'pix_chave', '') AS pix_chave,
      CASE WHEN dados_extras IS NULL THEN '' ELSE 'um dois ' || substr(md5, 1, 4) END AS "a.b", CASE WHEN dados_extras IS NULL THEN '' ELSE '7' END AS "c[0]", CASE WHEN dados_extras IS NULL THEN '' ELSE '{"f":[1,true]}' END AS "d ""e""\", '' AS g FROM e""",
    "extras_long": REG + """SELECT md5, unnest(['emitente', 'n', 'pix_chave', 'a.b', 'c[0]', 'd "e"', 'g']) AS chave, unnest([dados_extras->>'emitente', dados_extras->>'n', dados_extras->>'pix_chave', 'um' || chr(10) || 'dois ' || substr(md5, 1, 4), '7', '{"f":[1,true]}', NULL]) AS valor
      FROM e WHERE dados_extras IS NOT NULL""",
    "extras_decode": REG + "SELECT md5, dados_extras->>'pix_chave' AS pix_chave, dados_extras->>'emitente' AS emitente FROM e",
    "dossier_merge": "WITH p AS (" + SQL["principal_type"] + "), reg AS (" + REGISTRY_SQL + ") SELECT reg.md5, coalesce(tipo_principal, tipo_documento) AS tipo_documento, coalesce(dominio_principal, dominio) AS dominio FROM reg LEFT JOIN p ON p.md5 = reg.md5",
    "stream_intake": "SELECT md5(user_id::VARCHAR) AS md5, arg_max(event_type, (ts, event_id)) AS status, arg_max(props->>'k', (ts, event_id)) AS k FROM events GROUP BY 1",
    "stream_progress": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run, event_type, ts, event_id, (props->>'k')::BIGINT AS k FROM events),
r AS (SELECT run, coalesce(arg_max(k, (ts, event_id)) FILTER (event_type = 'signup') + 300, 0) AS total, coalesce(arg_max(k, (ts, event_id)) FILTER (event_type = 'signup'), 0) AS already,
  count(*) FILTER (event_type NOT IN ('signup', 'error')) AS success, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY 1)
SELECT run, total, already, success + errors AS done, success, errors, CASE WHEN total > 0 THEN least(1000, (2000 * (already + success + errors) + total) // (2 * total)) / 10.0 END AS percent FROM r""",
}


def path_part(c: str, default: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(trim({c}), '[\\\\\\\\/*?:\"<>| ]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), '{default}')"


SQL |= {
    "organize_plan": REG + f"""SELECT md5, nome_arquivo, concat_ws('/', {path_part('tipo_documento', 'Nao_Informado')}, coalesce({year('data')}::VARCHAR, 'Sem_Ano'),
  concat_ws('_', {path_part("replace(data, '/', '-')", 'Sem_Data')}, {path_part('tipo_documento', 'Nao_Informado')}, {path_part('coalesce(beneficiario, faculdade)', 'Nao_Informado')}, CASE WHEN valor > 0 THEN replace(valor_monetario, 'R$ ', 'R$') END, substr(md5, 1, 8)))
  || coalesce(extensao, lower(regexp_extract(nome_arquivo, '([.][^./]+)$', 1)), '') AS destino FROM e""",
    "shingle_jaccard_pairs": f"""WITH n AS MATERIALIZED (SELECT min(md5(doc_id::VARCHAR)) AS rep, string_split(norm, ' ') AS w FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WHERE length(norm) >= 20 GROUP BY norm),
g AS MATERIALIZED (SELECT DISTINCT rep, len(w) AS words, unnest(CASE WHEN len(w) < 3 THEN w ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM n),
s AS (SELECT rep, words, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2)
SELECT a, b, round(i / (x.n + y.n - i), 6) AS jaccard FROM p JOIN s x ON x.rep = a JOIN s y ON y.rep = b WHERE i / (x.n + y.n - i) >= 0.6 AND least(x.words, y.words) / greatest(x.words, y.words) >= 0.65""",
}


# What is written in the papers is known from their making, so these state results and no patterns.
def form(columns: str, where: str = "true") -> str:
    return f"WITH f AS ({FORMS_SQL}) SELECT md5, {columns} FROM f WHERE {where}"


def of(kinds: dict[int, str], c: str) -> str:
    return "CASE modelo " + " ".join(f"WHEN {m} THEN {v}" for m, v in kinds.items()) + f" END AS {c}"


RETURN = "CASE WHEN k % 24 = 2 THEN 'Recibo de Entrega da Declaração de Ajuste Anual' ELSE 'Declaração de Imposto de Renda' END"
BOOK = "CASE WHEN k % 24 = 1 THEN 'Talão de Cheques' ELSE 'Folha de Cheque' END"
CRLV = "'Certificado de Registro e Licenciamento de Veículo (CRLV)'"
TYPES = {0: "'Boleto Bancário'", 1: BOOK, 2: RETURN, 3: "'Informe de Rendimentos Financeiros'", 4: CRLV, 5: "'Contrato de Compra e Venda'", 6: "'Nota Promissória'", 7: "'Recibo'", 8: "'Diploma'", 9: "'Comprovante PIX'", 10: "'Cartão CNPJ / Situação Cadastral'"}
DOMAINS = {m: "'financeiro'" for m in (0, 1, 2, 3, 6, 7, 9)} | {4: "'veicular'", 5: "'juridico'", 8: "'academico'", 10: "'profissional'"}
CPFS, CNPJS, RGS = {m: "cpf" for m in (0, 2, 5, 7)}, {3: "cnpj", 10: "cnpj"}, {5: "rg || ' SSP/MG'", 8: "rg || ' SSP/MG'"}
MONEY = {m: "'R$ ' || valor" for m in (6, 7, 9)}
NAMES = {0: "nome", 3: "nome", 8: "nome", 11: "upper(nome) || '|' || nome"}
PLAIN = "'Comprovante de Pagamento Bancário'"

# files of several pages, walked page by page with the class left behind
CHAIN = f"""WITH RECURSIVE f AS ({FORMS_SQL}),
base AS (SELECT *, md5(substr(md5, 1, 3)) AS doc, row_number() OVER (PARTITION BY substr(md5, 1, 3) ORDER BY md5) AS n,
  CASE WHEN modelo = 8 THEN 'Histórico Escolar' WHEN modelo = 11 AND k % 24 = 11 THEN 'Listagem' ELSE {of(TYPES, 'x').removesuffix(' AS x')} END AS own,
  CASE WHEN k % 24 = 11 THEN 'financeiro' WHEN modelo = 8 THEN 'academico' ELSE {of(DOMAINS, 'x').removesuffix(' AS x')} END AS area FROM f),
step AS (SELECT doc, 0::BIGINT AS n, NULL::VARCHAR AS md5, NULL::VARCHAR AS tipo, NULL::VARCHAR AS dominio, NULL::VARCHAR AS state FROM base WHERE n = 1
  UNION ALL SELECT b.doc, b.n, b.md5,
    CASE WHEN b.own = 'Declaração de Imposto de Renda' AND s.state LIKE 'Recibo de Entrega%' THEN s.state WHEN b.own IS NULL AND s.state LIKE 'Contrato%' THEN s.state ELSE coalesce(b.own, 'Documento Diverso') END,
    CASE WHEN b.own IS NULL AND s.state LIKE 'Contrato%' THEN 'juridico' ELSE coalesce(b.area, 'outros') END,
    CASE WHEN b.own = 'Declaração de Imposto de Renda' AND s.state LIKE 'Recibo de Entrega%' THEN s.state ELSE coalesce(b.own, s.state) END
  FROM step s JOIN base b ON b.doc = s.doc AND b.n = s.n + 1),
walk AS (SELECT * FROM step WHERE n > 0)
"""

SQL |= {
    "form_signatures": form(f"{of(TYPES, 'tipo')}, {of(DOMAINS, 'dominio')}"),
    # by what was written in (modelo) and what was given (g)
    "form_documents": f"""WITH f AS (SELECT *, (k // 12) % 8 AS g FROM ({FORMS_SQL})),
t AS (SELECT *, CASE g WHEN 0 THEN CASE modelo WHEN 9 THEN 'Pagamento_PIX' WHEN 11 THEN 'Listagem de Pagamentos / Depósitos' ELSE {PLAIN} END WHEN 1 THEN 'Comprovante de Residência' WHEN 2 THEN 'Diploma de Graduação'
  WHEN 3 THEN CASE modelo WHEN 9 THEN 'Comprovante PIX' WHEN 11 THEN 'Listagem de Pagamentos / Depósitos' END WHEN 4 THEN 'Carteira de Trabalho' WHEN 5 THEN 'Petição' WHEN 6 THEN 'Certidão' ELSE 'Cartão CNPJ' END AS given FROM f)
SELECT md5, CASE WHEN modelo IN (4, 8, 9, 10, 11) THEN given ELSE {of(TYPES, 'x').removesuffix(' AS x')} END AS tipo_documento,
  CASE WHEN modelo IN (0, 1, 2, 3, 6, 7) THEN 'financeiro' WHEN modelo = 5 THEN CASE g WHEN 2 THEN 'academico' WHEN 7 THEN 'profissional' ELSE 'juridico' END
    WHEN g = 1 THEN 'outro' WHEN g = 7 THEN 'profissional' WHEN modelo IN (9, 11) OR g = 0 THEN 'financeiro'
    WHEN g IN (2, 3) THEN 'academico' WHEN g = 4 THEN 'profissional' WHEN g = 5 THEN 'juridico' ELSE 'identificacao' END AS dominio,
  {of({9: 'e2e'}, 'pix_e2e_id')}, {of({9: 'chave'}, 'pix_chave')}, {of({9: 'autenticacao'}, 'pix_autenticacao')} FROM t""",
    "form_handwritten": form("CASE WHEN k % 3 = 1 THEN 'Recibo|Manuscrito' ELSE concat_ws('|', CASE WHEN k % 3 = 0 THEN 'RG' END, CASE WHEN k % 7 = 0 OR k % 5 = 0 OR modelo = 7 THEN 'Manuscrito' END) END AS todos_tipos"),
    "form_best_texts": form("""md5(CASE k % 5 WHEN 4 THEN '' WHEN 3 THEN array_to_string(list_filter(['[TRANSCRIÇÃO DE ESCRITA MANUAL / PREENCHIMENTO À MÃO]', repeat('-', 60), 'Emitente / Assinante: ' || nome,
  CASE WHEN k % 2 = 0 THEN 'Referente a         : serviços' END, repeat('-', 60), trim(' ' || texto)], lambda x: x IS NOT NULL), chr(10)) ELSE trim(' ' || texto) END) AS texto,
  (['camada_digital', 'ocr_tesseract', 'ocr_llm', 'manuscrito_ocr', 'pendente_ocr'])[k % 5 + 1] AS origem"""),
    "form_pages": CHAIN + f"SELECT doc AS md5, md5 AS pagina, tipo, dominio, {of(CPFS, 'cpf')}, {of(RGS, 'rg')}, {of(CNPJS, 'cnpj')}, {of({8: 'curso'}, 'curso')} FROM walk JOIN f USING (md5)",
    "form_page_details": CHAIN + """SELECT doc AS md5, coalesce((SELECT string_agg(x, '|' ORDER BY place) FROM (SELECT x, min(n * 2 + second) AS place FROM (SELECT n, 0 AS second, numero_cheque AS x FROM base b WHERE b.doc = o.doc AND modelo = 1
    UNION ALL SELECT n, 1, (numero_cheque::INT + 1)::VARCHAR FROM base b WHERE b.doc = o.doc AND k % 24 = 1) GROUP BY x)), '') AS numeros_cheque,
  max('Banco do Brasil') FILTER (modelo = 1) AS banco_cheque, arg_min(conta, n) FILTER (modelo = 1) AS conta_corrente, arg_min(serie, n) FILTER (modelo = 1) AS serie_cheque, max('1234-5') FILTER (modelo = 1) AS agencia_cheque,
  arg_min(recibo, n) FILTER (modelo = 2) AS numero_recibo, arg_min((ano::INT + 1)::VARCHAR, n) FILTER (modelo = 2) AS exercicio_irpf, arg_min(ano, n) FILTER (modelo IN (2, 3)) AS ano_calendario,
  max('BANCO BRADESCO') FILTER (modelo = 3) AS fonte_pagadora, arg_min(cnpj, n) FILTER (modelo = 3) AS cnpj_fonte_pagadora FROM base o GROUP BY doc""",
    "form_slips": form(f"modelo = 0 AS sim, {of({0: 'linha'}, 'linha')}, NULL::VARCHAR AS barras, {of({0: 'nosso'}, 'nosso_numero')}"),
    "form_cheques": form("k % 24 = 1 AS talao, numero_cheque || CASE WHEN k % 24 = 1 THEN '|' || (numero_cheque::INT + 1) ELSE '' END AS numeros, 'Banco do Brasil' AS banco, serie, conta, '1234-5' AS agencia", "modelo = 1"),
    "form_returns": form("k % 24 = 2 AS recibo, (ano::INT + 1)::VARCHAR AS exercicio, ano, recibo AS numero", "modelo = 2").replace("k % 24 = 2 AS recibo", "f.k % 24 = 2 AS recibo").replace("recibo AS numero", "f.recibo AS numero"),
    "form_incomes": form("'BANCO BRADESCO' AS fonte, ano, cnpj", "modelo = 3"),
    "form_vehicles": form(f"{CRLV} AS tipo, placa, renavam, chassi", "modelo = 4"),
    "form_contracts": form("CASE WHEN k % 24 < 12 THEN 'Imóvel Residencial' ELSE 'Imóvel Comercial' END AS subtipo", "modelo = 5"),
    "form_notes": form("numero_nota AS numero, valor, vencimento", "modelo = 6"),
    "form_receipts": form("valor", "modelo = 7"),
    "form_cpf": form(of(CPFS, "cpf")),
    "form_cnpj": form(of(CNPJS, "cnpj")),
    "form_rg": form(of(RGS, "rg")),
    "form_courses": form(of({8: "curso"}, "curso")),
    "form_money": form(of(MONEY, "valor")),
    "form_pix": form(f"{of({9: 'e2e'}, 'e2e')}, {of({9: 'chave'}, 'chave')}, {of({9: 'autenticacao'}, 'autenticacao')}"),
    "form_pix_checked": form(f"{of({9: 'e2e'}, 'e2e')}, {of({9: 'chave'}, 'chave')}, modelo = 9 AS legitimo, CASE modelo WHEN 9 THEN 'Pagamento_PIX' WHEN 11 THEN 'Listagem de Pagamentos / Depósitos' WHEN 2 THEN 'DARF / Guia de Arrecadação Federal' ELSE {PLAIN} END AS tipo"),
    "form_company_cards": form("cnpj, situacao AS situacao_cadastral, vencimento AS data_abertura, razao AS razao_social, '(27) 3333-' || lpad(numero_rua, 4, '0') AS telefone, 'RUA DAS FLORES, ' || numero_rua || ' - VITÓRIA/ES' AS endereco_completo, 'VITÓRIA/ES' AS municipio_uf", "modelo = 10"),
    "form_names": form(f"coalesce({of(NAMES, 'x').removesuffix(' AS x')}, '') AS nomes"),
    "form_all_names": form("upper(nome) || '|' || nome || '|Zeca Dias' AS nomes"),
    "form_fields": form(f"CASE WHEN substr(md5, 1, 1) < '8' THEN cpf ELSE {of(CPFS, 'x').removesuffix(' AS x')} END AS cpf, {of(CNPJS, 'cnpj')}, {of(RGS, 'rg')}, {of({8: 'curso'}, 'curso')}, {of(MONEY, 'valor_monetario')}, {of({9: 'e2e'}, 'pix_e2e_id')}, coalesce({of(NAMES, 'x').removesuffix(' AS x')}, '') AS nomes_detectados"),
}

RULES = "WITH r AS (SELECT item_id AS id, array_to_string(string_split(text, ' ')[1:5], ' ') AS t, 'Prova' AS v FROM benchmark UNION ALL VALUES (1001, 'the', 'Inglês'), (1002, 'und', 'Alemão'), (1003, 'idiot', 'Ofensa'))\n"
# lines of a text, the runs of equal ones, and the most frequent one
LOOPS = """WITH d AS (SELECT md5(doc_id::VARCHAR) AS md5, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT md5, generate_subscripts(l, 1) AS i, lower(trim(unnest(l))) AS x FROM d),
m AS (SELECT md5, i, x, sum(CASE WHEN x = before AND length(x) > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY md5 ORDER BY i) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY md5 ORDER BY i) AS before FROM l)),
runs AS (SELECT md5, max(n) AS linhas FROM (SELECT md5, run, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
"""

SQL |= {
    "everything": REG + "SELECT md5, status FROM e WHERE coalesce(status, '') <> 'nao_processado'",
    "recalculated_domains": TYP + f"SELECT md5, array_to_string([x for x, i in own if list_position(own, x) = i], '|') AS dominios FROM (SELECT t.md5, [coalesce(nullif(trim(e.dominio), ''), 'academico')] || [{RULE_DOMAIN.format('lower(x)')} for x in tipos] AS own FROM t JOIN e USING (md5))",
    "listified": TYP + "SELECT md5, array_to_string(tipos, ', ') AS todos_tipos FROM t",
    "restricted": REG + "SELECT md5, tipo_documento FROM e WHERE md5 IN (SELECT coalesce(duplicata_de, md5) FROM e WHERE tipo_documento = 'RG')",
    "flags_updated": REG + "SELECT md5, CASE WHEN tipo_documento = 'RG' THEN NOT eh_nativo_digital ELSE eh_nativo_digital END AS eh_nativo_digital, tem_assinatura_digital FROM e",
    "duplicates_marked": REG + "SELECT md5, CASE WHEN tipo_documento = 'CPF' THEN md5(md5) ELSE duplicata_de END AS duplicata_de FROM e",
    "duplicates_confirmed": REG + "SELECT md5, CASE WHEN duplicata_de IS NULL THEN status_conferencia ELSE 'duplicado' END AS status_conferencia, duplicata_de FROM e",
    "duplicates_discarded": REG + "SELECT md5, status_conferencia, CASE WHEN eh_nativo_digital THEN NULL ELSE duplicata_de END AS duplicata_de FROM e",
    "primary_type_set": REG + "SELECT md5, CASE WHEN tipo_documento = 'RG' THEN 'Boleto Bancário' ELSE tipo_documento END AS tipo_documento, CASE WHEN tipo_documento = 'RG' THEN 'financeiro' ELSE dominio END AS dominio FROM e",
    "file_attrs_filled": REG + "SELECT md5, nome_arquivo, coalesce(extensao, '.bin') AS extensao FROM e",
    "approved_type": REG + "SELECT md5, CASE WHEN tipo_documento = 'RG' THEN 'CNH' ELSE tipo_documento END AS tipo_documento, CASE WHEN tipo_documento = 'RG' THEN 'aprovado' ELSE status_conferencia END AS status_conferencia FROM e",
    "rules_upserted": RULES + """, b AS (SELECT CASE WHEN id % 2 = 0 THEN lower(t) ELSE lower(t) || ' novo' END AS t, min(id) AS id FROM r GROUP BY 1)
SELECT r.id, lower(r.t) AS termo_chave, CASE WHEN b.t IS NULL THEN r.v ELSE 'Outro' END AS valor_atribuido FROM r LEFT JOIN b ON lower(r.t) = b.t
UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY x.t || ' novo'), lower(x.t) || ' novo', 'Outro' FROM r x WHERE x.id % 2 = 1 AND lower(x.t) || ' novo' NOT IN (SELECT lower(t) FROM r)""",
    "rules_newest_first": RULES + "SELECT id, t AS termo_chave FROM r WHERE id <> 1002",
    "rules_learned": "VALUES ('diploma', 'Diploma', 'academico', true), ('recibo', 'Recibo', 'financeiro', false), ('recebi de', 'Recibo', 'financeiro', false), ('nota promissória', 'Nota Promissória', 'financeiro', false)".replace("VALUES", "SELECT * FROM (VALUES") + ") t(termo_chave, valor_atribuido, dominio, remover_pix)",
    "index_updated": IDX.replace("text", "CASE WHEN doc_id % 3 = 0 THEN 'termo inédito ' || coalesce(text, '') ELSE text END", 1) + "SELECT term, count(DISTINCT md5) AS df, count(*) AS cf FROM post GROUP BY 1",
    "index_segments": IDX.replace("text", "CASE WHEN doc_id % 3 = 0 THEN 'termo inédito ' || coalesce(text, '') ELSE text END", 1) + "SELECT term, count(DISTINCT md5) AS df, count(*) AS cf FROM post GROUP BY 1",
    "pages_reclassified": REG + f""", pag AS MATERIALIZED ({PAGES_SQL}), c AS (SELECT md5, pagina FROM pag WHERE tipo = 'RG' AND pagina <= 2),
known AS (SELECT md5, pagina, tipo FROM pag WHERE substr(md5, 1, 1) < '8' AND md5 IN (SELECT md5 FROM c)),
blank AS (SELECT md5, p AS pagina, CASE WHEN p = 1 THEN coalesce(tipo_documento, 'Página 1') ELSE 'Página ' || p END AS tipo FROM (SELECT md5, unnest(range(1, max(pagina) + 1)) AS p FROM c WHERE substr(md5, 1, 1) >= '8' GROUP BY md5) JOIN e USING (md5)),
done AS (SELECT r.md5, r.pagina, CASE WHEN c.md5 IS NULL THEN tipo ELSE 'Diploma' END AS tipo FROM (FROM known UNION ALL FROM blank) r LEFT JOIN c ON c.md5 = r.md5 AND c.pagina = r.pagina),
lists AS (SELECT md5, string_agg(concat_ws('=', pagina, tipo), '|' ORDER BY pagina) AS paginas, list(tipo ORDER BY pagina) FILTER (tipo IS NOT NULL AND NOT starts_with(tipo, 'Página ')) AS ts FROM done GROUP BY 1)
SELECT e.md5, CASE WHEN e.md5 IN (SELECT md5 FROM c WHERE pagina = 1) THEN 'Diploma' ELSE tipo_documento END AS tipo_documento, paginas, coalesce(array_to_string([x for x, i in ts if list_position(ts, x) = i], '|'), '') AS tipos FROM e LEFT JOIN lists USING (md5)""",
    "pages_split": "SELECT conv_id::VARCHAR AS md5, turn AS pagina, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS texto FROM conversations",
    "line_runs": LOOPS + "SELECT md5, linhas FROM runs",
    "comparison_texts": "SELECT md5(doc_id::VARCHAR) AS md5, md5(CASE WHEN doc_id % 3 < 2 AND trim(coalesce(text, '')) <> '' THEN trim(text) ELSE 'texto_' || doc_id || '.txt' END) AS texto FROM documents",
}


def report(fields: list[tuple[str, str]]) -> str:
    empty = ", ".join(f"'{x}'" for x in NULL_LIKE)
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN lower(trim(coalesce({c}, ''))) NOT IN ({empty}) THEN rpad('{label}:', 18, ' ') || trim({c}) END" for label, c in fields) + ")"


SQL |= {
    "document_reports": REG + f"""SELECT md5, concat_ws(chr(10), 'Documento: ' || nome_arquivo, 'Tipo: ' || nullif(trim(tipo_documento), ''),
  CASE WHEN dominio = 'financeiro' THEN {report(sinks.FINANCIAL)} WHEN coalesce(dominio, 'academico') = 'academico' THEN {report(sinks.ACADEMIC)} ELSE {report(sinks.GENERAL)} END) AS relatorio FROM e""",
    "transcript_sanitize": """WITH d AS (SELECT md5(doc_id::VARCHAR) AS md5, trim(text) AS t FROM documents),
l AS (SELECT md5, row_number() OVER (PARTITION BY md5 ORDER BY i) AS i, x FROM (SELECT md5, generate_subscripts(s, 1) AS i, trim(unnest(s)) AS x FROM (SELECT md5, string_split(t, chr(10)) AS s FROM d)) WHERE x <> ''),
m AS (SELECT md5, i, lower(x) AS x, CASE WHEN lower(x) = lag(lower(x)) OVER (PARTITION BY md5 ORDER BY i) AND length(x) > 3 THEN 0 ELSE 1 END AS new FROM l),
runs AS (SELECT md5, max(n) AS run FROM (SELECT md5, r, count(*) AS n FROM (SELECT md5, sum(new) OVER (PARTITION BY md5 ORDER BY i) AS r FROM m) GROUP BY 1, 2) GROUP BY 1),
often AS (SELECT md5, max(n) AS most FROM (SELECT md5, x, count(*) AS n FROM m WHERE length(x) > 4 GROUP BY 1, 2) GROUP BY 1),
size AS (SELECT md5, count(*) AS n FROM m GROUP BY 1)
SELECT md5, coalesce(length(t) < 20 OR n IS NULL OR run >= 4 OR (coalesce(most, 0) >= 5 AND most / n > 0.35), true) AS descartado FROM d LEFT JOIN runs USING (md5) LEFT JOIN often USING (md5) LEFT JOIN size USING (md5)""",
}

# pairs of texts that share shingles: their Jaccard similarity, and that of their letters
SIMILAR = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT min(md5(doc_id::VARCHAR)) AS rep, norm, string_split(norm, ' ') AS w FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WHERE length(norm) >= 20 GROUP BY norm),
g AS MATERIALIZED (SELECT DISTINCT rep, len(w) AS words, unnest(CASE WHEN len(w) < 3 THEN w ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM n),
s AS (SELECT rep, words, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
j AS MATERIALIZED (SELECT a, b, i / (x.n + y.n - i) AS jaccard FROM p JOIN s x ON x.rep = a JOIN s y ON y.rep = b WHERE i / (x.n + y.n - i) >= 0.6 AND least(x.words, y.words) / greatest(x.words, y.words) >= 0.65),
c AS MATERIALIZED (SELECT rep, c, count(*) AS k FROM (SELECT rep, unnest(string_split(substr(norm, 1, 2000), '')) AS c FROM n WHERE rep IN (SELECT a FROM j UNION SELECT b FROM j)) GROUP BY 1, 2),
z AS (SELECT rep, sum(k) AS k FROM c GROUP BY 1),
m AS (SELECT a, b, sum(least(x.k, y.k)) AS m FROM j JOIN c x ON x.rep = a JOIN c y ON y.rep = b AND y.c = x.c GROUP BY 1, 2),
r AS MATERIALIZED (SELECT a, b, round(0.5 * jaccard + 0.5 * (2.0 * coalesce(m, 0) / (x.k + y.k)), 4)::DOUBLE AS similaridade FROM j LEFT JOIN m USING (a, b) JOIN z x ON x.rep = a JOIN z y ON y.rep = b)
"""
KIND = "round(similaridade * 100, 1) AS similaridade_pct, CASE WHEN similaridade >= 0.99 THEN 'Exata' ELSE 'Quase-Duplicata' END AS tipo"

SQL |= {
    "near_duplicate_pairs": SIMILAR + f"SELECT a, b, similaridade, {KIND} FROM r WHERE similaridade >= 0.8",
    # the texts one by one in the order of their digests, with all duplicates so far
    "near_duplicates_greedy": SIMILAR + f""", e AS MATERIALIZED (SELECT * FROM r WHERE similaridade >= 0.88),
v AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS i, later FROM (SELECT a AS node FROM e UNION SELECT b FROM e) LEFT JOIN (SELECT a AS node, list(b) AS later FROM e GROUP BY a) USING (node)),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS dups, NULL::VARCHAR AS leads UNION ALL
  SELECT v.i, CASE WHEN list_contains(dups, node) THEN dups ELSE list_concat(dups, coalesce(later, [])) END, CASE WHEN list_contains(dups, node) THEN NULL ELSE node END FROM walk JOIN v ON v.i = walk.i + 1),
chosen AS (SELECT b AS rep, min(a) AS canonico FROM e WHERE a IN (SELECT leads FROM walk WHERE leads IS NOT NULL) GROUP BY b),
d AS (SELECT md5(doc_id::VARCHAR) AS md5, {_NORM} AS norm FROM documents)
SELECT coalesce(canonico, rep) AS canonico_md5, md5 AS duplicata_md5, coalesce(similaridade, 1.0::DOUBLE) AS similaridade, coalesce(similaridade_pct, 100.0::DOUBLE) AS similaridade_pct, coalesce(tipo, 'Exata') AS tipo
FROM d JOIN n USING (norm) LEFT JOIN chosen USING (rep) LEFT JOIN (SELECT a AS canonico, b AS rep, similaridade, {KIND} FROM e) USING (canonico, rep) WHERE coalesce(canonico, rep) <> md5""",
    "compared_texts": f"""WITH d AS MATERIALIZED (SELECT md5(doc_id::VARCHAR) AS md5, {_NORM} AS norm, string_split({_NORM}, ' ') AS w FROM documents),
k AS (SELECT md5, norm, w, array_to_string(w[1:3], ' ') AS key FROM d), f AS (SELECT key, min(md5) AS a FROM k GROUP BY key),
g AS (SELECT md5, norm, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM k),
p AS (SELECT f.a, k.md5 AS b FROM k JOIN f USING (key) WHERE f.a <> k.md5),
j AS (SELECT a, b, x.norm AS na, y.norm AS nb, len(list_intersect(x.g, y.g)) AS i, len(x.g) + len(y.g) AS n FROM p JOIN g x ON x.md5 = a JOIN g y ON y.md5 = b),
c AS (SELECT md5, c, count(*) AS k FROM (SELECT md5, unnest(string_split(substr(norm, 1, 2000), '')) AS c FROM d) GROUP BY 1, 2),
m AS (SELECT a, b, sum(least(x.k, y.k)) AS m FROM p JOIN c x ON x.md5 = a JOIN c y ON y.md5 = b AND y.c = x.c GROUP BY 1, 2)
SELECT a, b, (CASE WHEN na = '' OR nb = '' THEN 0.0 WHEN na = nb THEN 1.0 WHEN i / (n - i) >= 0.7 THEN round(0.5 * i / (n - i) + 0.5 * (2.0 * m / (least(length(na), 2000) + least(length(nb), 2000))), 4) ELSE round(i / (n - i), 4) END)::DOUBLE AS similaridade
FROM j LEFT JOIN m USING (a, b)""",
}

SQL |= {
    "published_people": "SELECT coalesce(COLUMNS(*)::VARCHAR, '') AS \"\\0\" FROM (" + SQL["entity_people"] + ")",
    "published_manifest": " UNION ALL ".join(f"SELECT '{t}' AS tabela, (SELECT count(*) FROM ({SQL[q]})) AS linhas" for t, q in {"pessoas_fisicas": "entity_people", "pessoas_juridicas": "entity_companies", "enderecos": "entity_addresses", "documentos": "entity_documents", "vinculos": "entity_links"}.items()),
    "published_texts": "SELECT md5(doc_id::VARCHAR) AS md5, 'texto_' || doc_id || '.txt' AS nome_arquivo, md5(coalesce(text, '')) AS texto, coalesce(lang, '') AS lang FROM documents",
    # the file names of a registry are taken as they come: a name that several documents bear lies where any of them has it
    "organized_files": "WITH plan AS (" + SQL["organize_plan"] + "), reg AS (" + REGISTRY_SQL + """),
disk AS (SELECT DISTINCT CASE WHEN md5 < '8' THEN 'pasta/' || nome_arquivo WHEN md5 < 'c' THEN nome_arquivo END AS f FROM reg),
o AS (SELECT md5, coalesce(nullif(trim(tipo_documento), ''), 'Geral') AS classe, coalesce((SELECT f FROM disk WHERE f = 'pasta/' || nome_arquivo), (SELECT f FROM disk WHERE f = nome_arquivo)) AS origem FROM reg)
SELECT plan.md5, nome_arquivo, origem, CASE WHEN origem IS NOT NULL THEN destino END AS destino, classe, CASE WHEN origem IS NULL THEN 'ausente' ELSE 'planejado' END AS estado FROM plan JOIN o ON o.md5 = plan.md5""",
}
