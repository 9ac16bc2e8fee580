"""Registry operators on small literal tables, and against brute force."""

import datetime
import itertools
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from acervo.functions import classes as C
from acervo.operators import automaton
from acervo.operators import classify as K
from acervo.operators import duplicates as D
from acervo.operators import entities as E
from acervo.operators import filters as L
from acervo.operators import pages as P
from acervo.operators import search as S
from acervo.operators import state as R
from acervo.operators import stats
from acervo.schema import DOC_SCHEMA, reconcile_schema
from acervo.sources import files as I
from acervo.sources import publish as W
from acervo.sources import sinks as O
from acervo.streaming import intake as N
from acervo.streaming import progress as G
from acervo.streaming.segments import Segments, index_stream


def registry(spark, rows):
    cols = [f.name for f in DOC_SCHEMA.fields]
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], DOC_SCHEMA)
    extra = ["todos_tipos_texto", "endereco_completo", "fonte_pagadora", "cnpj_fonte_pagadora", "razao_social", "vendedor", "comprador"]
    more = spark.createDataFrame([(r["md5"], *[r.get(c) for c in extra]) for r in rows], "md5 string, " + ", ".join(f"{c} string" for c in extra))
    return df.join(more, "md5")


def test_brackets_and_kpis(spark):
    df = registry(spark, [{"md5": "a", "valor_monetario": "R$ 500,00", "status_conferencia": "aprovado"}, {"md5": "b", "valor_monetario": "R$ 250,00"}])
    assert stats.kpis(df).first().total == 750.0
    assert {r.rotulo: r.documentos for r in stats.value_brackets(df, (1000, 200, 600)).collect()}["R$ 200 a 600"] == 2
    assert stats.kpis(df.limit(0)).first().asDict() == {"documentos": 0, "com_valor": 0, "total": 0.0, "ticket_medio": 0.0, "maior": 0.0}
    assert [r.documentos for r in stats.value_brackets(df.limit(0)).collect()] == [0] * 5


def test_escalation(spark):
    rows = [{"md5": "1", "status": "erro"}, {"md5": "2", "tipo_documento": "Outro"}, {"md5": "3", "tipo_documento": "Diploma", "dominio": "academico"}, {"md5": "4", "tipo_documento": "Recibo", "dominio": "financeiro"}, {"md5": "5", "tipo_documento": "RG", "dominio": "identificacao"}]
    got = {r.md5: r.x for r in L.with_types(registry(spark, rows)).select("md5", L.escalation_reason().alias("x")).collect()}
    assert got == {"1": "falha_leitura_local (erro_leitura)", "2": "tipo_documento_inconclusivo", "3": "beneficiario_ausente", "4": "dados_financeiros_essenciais_ausentes", "5": None}


def test_dossiers(spark):
    df = registry(spark, [{"md5": "a", "cpf": "111.444.777-35"}, {"md5": "b", "cpf": "11144477735", "beneficiario": "Ana Souza"}, {"md5": "c", "cpf": "529.982.247-25"}])
    assert [(r.total_documentos, r.nome_titular) for r in E.dossiers(df).collect()] == [(2, "Ana Souza")]
    assert {r.md5: r.dossie_id is not None for r in E.assign(df).collect()} == {"a": True, "b": True, "c": False}


def test_entities(spark):
    cpf = "111.444.777-35"
    df = registry(spark, [{"md5": "a", "beneficiario": "Ana Lima", "cpf": cpf}, {"md5": "b", "beneficiario": "ANA LIMA", "cpf": cpf, "vendedor": "Bia Reis", "endereco_completo": "Rua 1"}, {"md5": "c", "beneficiario": "Caio"}, {"md5": "d", "beneficiario": "Caio", "endereco_completo": "Rua 1"}])
    people = {r.entidade_id: r for r in E.people(df).collect()}
    assert people["PF_11144477735"].documentos_md5 == ["a", "b"] and len(people) == 4
    assert E.addresses(df).count() == 2
    assert {r.entidade_id for r in E.links(df).collect()} == set(people)


def test_upsert_and_plan(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "md5 string, cpf string, erro string")
    new = spark.createDataFrame([("b", None, None, 1), ("b", "z", "3", 0), ("c", "w", None, 0)], "md5 string, cpf string, erro string, n int")
    got = {r.md5: (r.cpf, r.erro) for r in R.upsert(old, new, ["cpf"], "n").collect()}
    assert got == {"a": ("x", "1"), "b": ("z", None), "c": ("w", None)}
    reg = registry(spark, [{"md5": "a", "status": "sucesso"}, {"md5": "b", "status": "erro"}, {"md5": "c", "status": "erro", "status_conferencia": "aprovado"}])
    files = spark.createDataFrame([(m, f"{p}/{m}") for m in "abcd" for p in "xy"], "md5 string, caminho string")
    plan = lambda mode: {r.md5: r.acao for r in R.plan(files, reg, mode).collect()}
    assert plan("incremental") == {"a": "pronto", "b": "refazer", "c": "pronto", "d": "novo"}
    assert plan("force") == {"a": "refazer", "b": "refazer", "c": "refazer", "d": "novo"}


def test_rules(spark):
    rules = spark.createDataFrame([(1, "teste fatura especial", "Fatura", "financeiro"), (2, "oab", "OAB", "juridico")], "id long, termo_chave string, valor_atribuido string, dominio string")
    docs = spark.createDataFrame([("a", "um TESTE Fatura Especial oab"), ("b", "oaba"), ("c", "a OAB, sim")], "md5 string, texto string")
    want = {"a": "Fatura", "c": "OAB"}
    assert {r.md5: r.valor_atribuido for r in K.match_rules(docs, rules).collect()} == want


def similarity(a, b):
    """Brute force of the two tests on shingle sets."""
    import re

    norm = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())
    x, y = norm(a).split(), norm(b).split()
    s, t = ({" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else set(w) for w in (x, y))
    return len(s & t) / len(s | t) if s | t else 0, min(len(x), len(y)) / max(len(x), len(y), 1), len(norm(a)) >= 20 and len(norm(b)) >= 20


def test_near_duplicates_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(6, 40))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(3):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "md5 string, texto string")
    got = {(r.a, r.b) for r in D.similar_pairs(D._keep(D.classes(docs), "t")).collect()}
    want = {(f"{i:03d}", f"{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if (s := similarity(texts[i], texts[j]))[0] >= 0.6 and s[1] >= 0.65 and s[2]}
    assert got == want and want


def test_greedy_canonical(spark):
    text = "um texto bastante longo para comparar com outro texto igual"
    docs = spark.createDataFrame([(m, text) for m in "abc"] + [("d", "coisa inteiramente diversa escrita por outra pessoa")], "md5 string, texto string")
    assert {(r.canonico_md5, r.duplicata_md5, r.similaridade) for r in D.near_duplicates(docs).collect()} == {("a", "b", 1.0), ("a", "c", 1.0)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {(r.canonico, r.duplicata) for r in D.canonical(edges).collect()} == {("a", "b"), ("c", "d")}


def greedy(edges):
    """Canonical choice node by node, in order."""
    later, of = {}, {}
    for a, b in edges:
        later.setdefault(a, set()).add(b)
    for node in sorted({x for e in edges for x in e}):
        if node not in of:
            for b in later.get(node, ()):
                of.setdefault(b, node)
    return {(a, b) for b, a in of.items()}


def test_greedy_canonical_brute_force(spark):
    import random

    # z9 has the leader z3 at once, but z2 leads too, a round later, and is smaller
    late = [("z0", "z1"), ("z1", "z2"), ("z2", "z9"), ("z3", "z9")]
    rng = random.Random(5)
    names = [f"{i:02d}" for i in range(40)]
    drawn = [late, [], [("a", "b"), ("a", "b")], *[list({tuple(sorted(rng.sample(names, 2))) for _ in range(n)}) for n in (20, 60)]]
    for edges in drawn:
        got = [(r.canonico, r.duplicata) for r in D.canonical(spark.createDataFrame(edges, "a string, b string")).collect()]
        assert set(got) == greedy(edges) and len(got) == len(set(got))


def test_greedy_canonical_long_chain(spark, caplog):
    import hashlib

    nodes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(10_000)]
    edges = [tuple(sorted(e)) for e in itertools.pairwise(nodes)]
    with caplog.at_level("INFO", logger="acervo.operators.duplicates"):
        got = {(r.canonico, r.duplicata) for r in D.canonical(spark.createDataFrame(edges, "a string, b string")).collect()}
    rounds = int(re.search(r"after (\d+) rounds", caplog.text)[1])
    assert got == greedy(edges) and rounds <= 12


def test_similar_pairs_with_a_gram_in_every_text(spark):
    import random

    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 30))] for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(4):
            t = list(b)
            t[rng.randrange(len(t))] = "x"
            texts.append("um mesmo começo " * rng.randint(1, 2) + " ".join(t))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "md5 string, texto string")
    kinds = D._keep(D.classes(docs), "t")
    want = {(f"{i:03d}", f"{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if (s := similarity(texts[i], texts[j]))[0] >= 0.6 and s[1] >= 0.65 and s[2]}
    for block in (7, 2000):
        assert {(r.a, r.b) for r in D.similar_pairs(kinds, block=block).collect()} == want and want
    # every entry of a crowded gram and band is dealt out: no cell holds more than its share
    index = D.prefix_index(kinds, 0.1)
    crowded = index.groupBy("g", "band").count().agg(F.max("count")).first()[0]
    assert crowded > 50
    every = {(f"{i:03d}", f"{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if similarity(texts[i], texts[j])[0] >= 0.3}
    near = {(r.a, r.b) for r in D.candidates(D.prefix_index(kinds, 0.3), 0.3, 7).collect()}
    assert every <= near


def test_domain_consolidation(spark):
    rows = [
        ("Diploma", None, "Diploma", None, False, False, None, None, "Diploma", "academico"),
        ("Diploma", None, "Diploma", None, False, False, None, "R$ 1,00", "Diploma", "financeiro"),
        ("Comprovante de Inscrição", "financeiro", None, None, False, True, "DARF", "R$ 1,00", "Comprovante de Inscrição", "financeiro"),
        ("Comprovante de Inscrição", "outro", None, None, False, True, "DARF", "R$ 1,00", "Comprovante de Inscrição", "outro"),
        (None, None, None, None, False, True, None, None, "Comprovante PIX", "financeiro"),
        ("Outro", None, "Outro", None, False, False, "DARF", None, "DARF", "financeiro"),
        ("outro", "financeiro", "outro", "financeiro", False, False, None, None, "Recibo de Pagamento", "financeiro"),
        (None, None, "Cartão CNPJ", None, False, False, None, None, "Cartão CNPJ / Situação Cadastral", "profissional"),
        ("Passaporte", "juridico", None, None, False, False, None, None, "Passaporte", "identificacao"),
        ("Procuração", "x", None, None, False, False, None, None, "Procuração", "juridico"),
        ("Jornal", "veicular", None, None, False, False, None, None, "Jornal", "academico"),
        ("Matrícula", None, None, None, True, False, None, None, "Matrícula", "financeiro"),
    ]
    df = spark.createDataFrame(rows, "kind string, domain string, told string, area string, certain boolean, pix boolean, payment string, value string, tipo string, dominio string")
    got = df.select("tipo", "dominio", C.consolidate_domain(*[F.col(c) for c in ("kind", "domain", "told", "area", "certain", "pix", "payment", "value")]).alias("g")).collect()
    assert [(r.g.tipo, r.g.dominio) for r in got] == [(r.tipo, r.dominio) for r in got]


def test_export_in_two_phases(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    odd = [("a", ' um "dois"\n\ttrês, quatro \r\n', ["x", "y"]), ("b", None, []), ("c", "", None), ("d", '"', ["\\"])]
    df = spark.createDataFrame(odd, "md5 string, texto string, lista array<string>")
    first = W.publish({"t": df, "vazia": df.filter("false")}, root)
    read = lambda: {(r.md5, r.texto, r.lista) for r in W.published(spark, root, "t").collect()}
    assert read() == {(m, t or "", ";".join(x or [])) for m, t, x in odd}
    assert {(r.tabela, r.linhas) for r in W.manifest(spark, root).collect()} == {("t", 4), ("vazia", 0)}
    assert W.published(spark, root, "vazia").columns == df.columns and W.published(spark, root, "vazia").isEmpty()
    # readers of the first version keep it, new ones see the second
    old = W.published(spark, root, "t")
    second = W.publish({"t": df.limit(1)}, root)
    assert W.current(spark, root) == second != first and old.count() == 4 and len(read()) == 1
    # a run that fails publishes nothing
    broken = df.withColumn("texto", F.raise_error(F.lit("x")))
    with pytest.raises(Exception):
        W.publish({"t": broken}, root)
    assert W.current(spark, root) == second and len(read()) == 1
    with pytest.raises(KeyError):
        W.published(spark, root, "outra")


def test_search(spark):
    docs = spark.createDataFrame([("1", "Índice alfa beta"), ("2", "alfa gama")], "md5 string, t string")
    post, size = S.build_index(docs, ["t"]), S.sizes(docs, ["t"])
    run = lambda q: sorted(r.md5 for r in S.search(post, size, q).collect())
    assert run("indice") == run("ÍNDICE") == ["1"]
    assert run("alfa AND beta") == ["1"] and run("alfa NOT beta") == ["2"] and run("gam") == ["2"] and run("beta OR gama") == ["1", "2"]
    assert run('"alfa beta"') == ["1"] and run('"alfa beta') == ["1"] and run("  ") == []
    assert "<mark>Índice</mark>" in docs.filter("md5 = '1'").select(S.snippet("t", "indice").alias("s")).first().s
    changed = spark.createDataFrame([("1", "delta")], "md5 string, t string")
    again = S.update_index(post, changed, ["t"])
    assert [r.md5 for r in S.search(again, size, "beta").collect()] == [] and [r.md5 for r in S.search(again, size, "delta").collect()] == ["1"]


def test_pages(spark):
    rows = [("a", 1, "Contrato", "juridico", "x"), ("a", 2, None, "outros", "cláusula dois"), ("a", 3, P.NOTHING, "outros", "o foro"), ("a", 4, "RG", "identificacao", "x"), ("a", 5, None, "outros", "cláusula três"), ("b", 1, P.RETURN, "financeiro", ""), ("b", 2, P.RECEIPT, "financeiro", "")]
    p = spark.createDataFrame(rows, "md5 string, pagina int, tipo string, dominio string, texto string")
    assert [r.tipo for r in P.carry_contracts(p).filter("md5 = 'a'").orderBy("pagina").collect()] == ["Contrato", "Contrato", "Contrato", "RG", None]
    assert [r.dominio for r in P.carry_contracts(p).filter("md5 = 'a'").orderBy("pagina").collect()] == ["juridico", "juridico", "juridico", "identificacao", "outros"]
    assert {r.tipo for r in P.merge_returns(p).filter("md5 = 'b'").collect()} == {P.RECEIPT}
    marked = spark.createDataFrame([("a", "--- PÁGINA 1 ---\num\n=== PÁGINA 2 ===\ndois")], "md5 string, texto string")
    assert [(r.pagina, r.texto) for r in P.split_pages(marked).orderBy("pagina").collect()] == [(1, "um"), (2, "dois")]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("olá".encode("cp1252"))
    (tmp_path / "b.xyz").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<d xmlns:w='w'><w:p><w:t>Um</w:t></w:p><w:p><w:t>Dois</w:t></w:p></d>")
        z.writestr("docProps/core.xml", "<c xmlns:d='d'><d:title>T</d:title><d:lastModifiedBy>Ana</d:lastModifiedBy></c>")
    found = I.discover(spark, str(tmp_path))
    names = {r.nome_arquivo: r.extensao for r in I.fingerprint(found).collect()}
    assert names == {"a.TXT": ".txt", "c.docx": ".docx"}
    assert found.filter("path like '%TXT'").select(I.decode_text("content").alias("t")).first().t == "olá"
    office = {r.caminho.rpartition("/")[2]: r for r in I.office_text(found).collect()}
    assert office["c.docx"].texto == "Um\n\nDois" and office["c.docx"].dublin_core == {"title": "T", "contributor": "Ana", "creator_tool": "Ana"} and office["a.TXT"].texto == ""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.pdf").write_bytes(b"%PDF /ByteRange [0] CN=Fulano de Tal, Certisign")
    got = I.inspect_signatures(I.discover(spark, str(tmp_path / "s"))).first()
    assert got.tem_assinatura_digital and got.assinantes == ["Fulano de Tal"] and got.autoridades == ["Certisign"]


def test_reports_and_schema(spark, tmp_path):
    df = registry(spark, [{"md5": "b", "nome_arquivo": "b.pdf", "status": "sucesso", "curso": "Direito", "beneficiario": "null"}, {"md5": "a", "nome_arquivo": "a.pdf", "status": "nao_processado"}])
    assert [r.linha.split(" | ")[1] for r in O.consolidated_report(df).collect()[1:]] == ["a.pdf", "b.pdf"]
    assert "Titular" not in O.document_reports(df).filter("md5 = 'b'").first().relatorio
    O.write_registry_json(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    more = reconcile_schema(spark.createDataFrame([("a", "v")], "md5 string, novo string")).first()
    assert more.dados_extras == '{"novo":"v"}' and len(more) == len(DOC_SCHEMA.fields)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"{i % 7}", f"s{i}", datetime.datetime(2024, 1, 1, 0, i)) for i in range(20)]
    schema = "md5 string, status string, at timestamp"
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = N.Table(spark, f"file://{tmp_path}/table")
    last = lambda b: b.groupBy("md5").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        N.intake(stream, table, last, f"file://{tmp_path}/checkpoint", keep=[]).awaitTermination()
        return {r.md5: r.status for r in table.latest().collect()}

    want = {m: s for m, s, _ in rows}
    first = run()
    assert set(first) == set(want)
    assert run() == first  # nothing new: nothing changes


@pytest.mark.parametrize("name", ["kpis", "value_brackets", "upsert_merge", "principal_type", "bm25_search"])
def test_against_duckdb(spark, name):
    import duckdb

    from acervo.plans import oracle, queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "nation customer orders lineitem documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(oracle.SQL[name]).df()
    got = queries.QUERIES[name](spark, d).toPandas()[list(want.columns)]
    key = lambda x: sorted(map(str, x.astype(object).where(x.notna(), None).itertuples(index=False, name=None)))
    assert key(got.round(4)) == key(want.round(4))


def test_entry_without_training_data_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "kpis" in entry.queries() and not any(q.startswith("op") and q[2].isdigit() for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_rules_match_alike_at_every_size(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "superrecibo de venda"), ("b", "o x. aqui"), ("c", "ab cd"), ("d", "R$ 10 e 50% off"), ("e", None), ("f", "abcdefgh")], "md5 string, texto string")
    terms = ["recibo de", "x", "ab", "r$", "%", "cdef", "bcdefg", "zzz", " "]
    rules = spark.createDataFrame([(i, t, f"v{i}", "outro") for i, t in enumerate(terms)], "id long, termo_chave string, valor_atribuido string, dominio string")
    found = []
    for letters in (automaton.BLOCK_LETTERS, 3):
        monkeypatch.setattr(automaton, "BLOCK_LETTERS", letters)
        found.append({r.md5: r.termo_chave for r in K.match_rules(docs, rules).collect()})
    assert K.match_rules(docs, rules.limit(0)).count() == 0 and K.match_rules(docs.limit(0), rules).count() == 0
    assert found[0] == found[1] and found[0]["a"] == "recibo de" and found[0]["b"] == "x" and found[0]["c"] == "ab" and found[0]["f"] == "bcdefg"
    assert [r.id for r in K.newest_first(rules).collect()] == list(range(len(terms) - 1, -1, -1))


def test_slips_and_cheques_in_scanned_text(spark):
    of = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f("t").alias("x")).first().x
    utility = "836900000012345678901234567890123456789012345678"
    spaced = " ".join(utility[i : i + 12] for i in range(0, 48, 12))
    assert of(K.slip, f"conta {spaced} fim").linha == spaced
    assert of(K.slip, "leitura SS3690000001234567890123 4567890123456789012345").linha == "88" + "3690000001234567890123 4567890123456789012345"
    assert not of(K.slip, "ola").sim
    got = of(K.cheque, "SICOOB cooperativa 3008 série 001 conta: 00038123-4\ncheque 000123 e cheque 000124")
    assert (got.sim, got.talao, got.numeros, got.banco, got.serie, got.conta, got.agencia) == (True, True, ["000123", "000124"], "SICOOB", "001", "00038123-4", "3008")
    assert of(K.cheque, "folha de cheque do banco 850017").numeros == ["850017"]


def test_reclassified_pages_and_saved_rows(spark):
    df = spark.createDataFrame([("a", "RG", "identificacao", "pendente"), ("b", "Recibo", "financeiro", "pendente"), ("c", "CNH", "identificacao", "pendente")], "md5 string, tipo_documento string, dominio string, status_conferencia string")
    pages = spark.createDataFrame([("a", 1, "RG", "registro geral de fulano"), ("a", 2, "Recibo", "recebi de beltrano a quantia")], "md5 string, pagina int, tipo string, texto string")
    changes = spark.createDataFrame([("a", 1, "Diploma"), ("b", 3, "RG")], "md5 string, pagina int, tipo string")
    got = {r.md5: r for r in R.reclassify(df, pages, changes).collect()}
    assert (got["a"].tipo_documento, got["a"].todos_tipos) == ("Diploma", ["Diploma", "Recibo"])
    assert [(p.pagina, p.tipo) for p in got["b"].dossie_paginas] == [(1, "Recibo"), (2, "Página 2"), (3, "RG")]
    assert (got["b"].tipo_documento, got["b"].todos_tipos, got["b"].todos_dominios) == ("Recibo", ["Recibo", "RG"], ["financeiro", "identificacao"])
    assert got["c"].dossie_paginas is None and got["c"].tipo_documento == "CNH"
    rules = spark.createDataFrame([], "id long, termo_chave string, campo_alvo string, valor_atribuido string, dominio string, remover_pix boolean, origem_md5 string")
    saved, learned = R.save_reviewed(df, rules, df.filter("md5 = 'a'").withColumn("tipo_documento", F.lit("CNH")), pages, "hoje")
    assert {r.md5: (r.tipo_documento, r.status_conferencia) for r in saved.collect()} == {"a": ("CNH", "aprovado"), "b": ("Recibo", "pendente"), "c": ("CNH", "pendente")}
    assert {r.valor_atribuido for r in learned.collect()} <= {"RG", "Recibo"} and learned.count() > 0


def test_intake_updates_the_index(spark, tmp_path):
    root = f"file://{tmp_path}"
    table, index = N.Table(spark, f"{root}/table"), N.Table(spark, f"{root}/index")
    schema = "md5 string, texto string, n int"
    for k, rows in enumerate([[("aa1", "velho termo", 1), ("bb2", "outro", 1)], [("aa1", "novo termo", 2)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        N.intake(stream, table, lambda b: b, f"{root}/checkpoint", keep=[], index=index, fields=["texto"]).awaitTermination()
    assert {r.md5: (r.texto, r.n) for r in table.latest().collect()} == {"aa1": ("novo termo", 2), "bb2": ("outro", 1)}
    assert sorted((r.term, r.md5) for r in index.latest().collect()) == [("novo", "aa1"), ("outro", "bb2"), ("termo", "aa1")]


def test_longest_terms_equal_brute_force(spark, monkeypatch):
    import random
    import re

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab .é") for _ in range(n))
    terms = {word(rng.randint(1, 7)).strip(): i for i in range(150)}
    terms.pop("", None)
    texts = {str(i): word(rng.randint(0, 40)) for i in range(120)}
    want = {}
    for k, text in texts.items():
        holds = [(len(t), i) for t, i in terms.items() if (re.search(r"\b" + re.escape(t) + r"\b", text) if len(t) <= 4 else t in text)]
        if holds:
            want[k] = max(holds)
    monkeypatch.setattr(automaton, "BLOCK_LETTERS", 100)
    got = automaton.longest_terms(spark.createDataFrame([*texts.items(), ("none", None)], "md5 string, low string"), spark.createDataFrame(list(terms.items()), "t string, id long"))
    assert {r.md5: (r.size, r.id) for r in got.collect()} == want


def test_snippet_shows_the_window_with_most_words(spark):
    text = " ".join(["alfa", *["x"] * 30, "beta", "y", "Alfa,", "z", "gama", *["w"] * 30, "alfa", "alfa"])
    show = lambda q, size=5: spark.createDataFrame([(text,)], "t string").select(S.snippet("t", q, size).alias("s")).first().s
    assert show("alfa beta gama") == "... <mark>beta</mark> y <mark>Alfa,</mark> z <mark>gama</mark> ..."
    assert show("beta", 5) == "... x x <mark>beta</mark> y Alfa, ..."
    assert show("alfa AND NOT beta", 3).startswith("... w <mark>alfa</mark> <mark>alfa</mark>")
    assert show("nada", 2) == "alfa x ..."


def test_page_chain_and_its_details(spark):
    receipt = "Receita Federal\nRecibo de Entrega da Declaração de Ajuste Anual\nExercício: 2023"
    tax = "Receita Federal\nDeclaração de Ajuste Anual\nExercício: 2024\nAno-Calendário: 2023"
    texts = [tax, receipt, tax, "texto solto qualquer", tax, "Nota Promissória\nPagável a esta praça", tax, "Compromisso de Compra e Venda\nPromitente Vendedor: Ana", "perante a testemunha", "lista de compras", "o foro da cidade"]
    rules = spark.createDataFrame([(1, "lista de compras", P.RETURN, None)], "id long, termo_chave string, valor_atribuido string, dominio string")
    out = K.classify_pages(spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "md5 string, pagina int, texto string"), rules)
    rows = out.orderBy("pagina").collect()
    assert [r.tipo for r in rows] == [P.RETURN, P.RECEIPT, P.RECEIPT, P.NOTHING, P.RECEIPT, "Nota Promissória", P.RETURN, "Contrato de Compra e Venda", "Contrato de Compra e Venda", P.RETURN, P.NOTHING]
    assert [r.dominio for r in rows][7:] == ["juridico", "juridico", "academico", "outros"]
    told = P.details(out).first()
    assert (told.exercicio_irpf, told.ano_calendario, told.numeros_cheque) == ("2024", "2023", [])


def test_progress_over_batches_in_any_order(spark, tmp_path):
    root = f"file://{tmp_path}"
    at = lambda n: datetime.datetime(2024, 1, 1, 0, 0, n)
    schema = "run string, event string, ts timestamp, number long, total long, already long, ok boolean"
    batches = [
        [("a", "file_done", at(5), 1, None, None, True), ("a", "ready", at(9), 2, 7, 1, None), ("b", "file_done", at(1), 3, None, None, None)],
        [("a", "ready", at(2), 4, 99, 0, None), ("a", "file_done", at(6), 5, None, None, False), (None, "file_done", at(6), 6, None, None, True), ("a", "init", at(1), 7, None, None, None)],
        [("a", "file_done", at(7), n, None, None, True) for n in range(10, 20)],
    ]
    table = N.Table(spark, f"{root}/table")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        G.follow(stream, table, f"{root}/checkpoint").awaitTermination()
        if k == 1:
            assert {tuple(r) for r in G.runs(table.latest()).collect()} == {("a", 7, 1, 2, 1, 1, 42.9), ("b", 0, 0, 1, 0, 1, None)}
    assert {tuple(r) for r in G.runs(table.latest()).collect()} == {("a", 7, 1, 12, 11, 1, 100.0), ("b", 0, 0, 1, 0, 1, None)}


def test_segments_bury_what_came_before(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/index")
    add = lambda rows, n: index.append(spark.createDataFrame(rows, "md5 string, t string"), ["t"], n)
    alive = lambda: sorted((r.term, r.md5, r.tf) for r in index.postings().collect())
    assert alive() == [] and index.docs().count() == 0
    add([("a", "um dois um"), ("b", "três")], 0)
    add([("a", "quatro"), ("c", None)], 1)
    want = [("quatro", "a", 1), ("tres", "b", 1)]
    assert alive() == want and {tuple(r) for r in index.docs().collect()} == {("a", 1, 1), ("b", 1, 0), ("c", 0, 1)}
    add([("a", "quatro"), ("c", None)], 1)  # the same batch again
    assert alive() == want
    index.compact()
    assert alive() == want and [n for _, n in index._folders()] == ["base-1"]
    index.vacuum()
    add([("b", ""), ("d", "um")], 2)
    assert alive() == [("quatro", "a", 1), ("um", "d", 1)]
    size = index.sizes().first()
    assert (size.docs, size.mean) == (4, 0.5)
    assert [r.md5 for r in S.search(index.postings(), index.sizes(), "quatro").collect()] == ["a"]


def test_flat_table_and_extras_with_any_key(spark):
    bags = ['{"a.b": "x\\ny", "c[0]": {"d": [1, true]}, "e\\"f": null, "CPF": "0"}', '{"g": 1.5}', "[1]", "no json", None]
    df = spark.createDataFrame([(str(i), True if i else None, b) for i, b in enumerate(bags)], "md5 string, tem_assinatura_digital boolean, dados_extras string")
    out = O.flat(df)
    assert out.columns == [*O.HEADERS.values(), "tem_assinatura_digital", "a.b", "c[0]", 'e"f', "g"] and len(O.HEADERS) == 26
    rows = {r.MD5: r for r in out.collect()}
    assert rows["0"]["a.b"] == "x y" and rows["0"]["c[0]"] == '{"d":[1,true]}' and rows["0"]['e"f'] == "" and rows["0"]["tem_assinatura_digital"] == "" and rows["1"]["tem_assinatura_digital"] == "Sim"
    assert rows["1"]["g"] == "1.5" and all(rows[k]["g"] == "" for k in "0234") and rows["0"]["CPF"] == ""
    assert {tuple(r) for r in O.extras(df).collect()} == {("0", "a.b", "x\ny"), ("0", "c[0]", '{"d":[1,true]}'), ("0", 'e"f', None), ("0", "CPF", "0"), ("1", "g", "1.5")}
    many = spark.range(300).selectExpr("cast(id as string) as md5", """concat('{"k', id, '": "v', id, '"}') as dados_extras""")
    wide = O.flat(many)
    assert set(wide.columns) == {*O.HEADERS.values(), *(f"k{i}" for i in range(300))}
    assert wide.filter("MD5 = '299'").select("k299", "k1").collect() == [("v299", "")]
    assert I.decode_rows(df, ["a.b"]).orderBy("md5").first()["a.b"] == "x\ny"


def test_returns_notes_and_vehicles_by_other_signs(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f("t").alias("s")).first().s
    note = one(K.promissory_note, "Vencimento 10/05/2024 avalista Fulano")
    assert note.sim and note.vencimento == "10/05/2024" and not one(K.promissory_note, "Vencimento 10/05/2024, sem mais").sim
    assert one(K.promissory_note, "Pagarei por esta ... Emitente: ANA DIAS\nR$ 1.234,50 Nº 12").emitente.startswith("ANA DIAS")
    got = one(K.tax_return, "Receita Federal\nNúmero do recibo 12.34.56.78.90 - 12\nTotal de rendimentos tributáveis: 1.234,56\nExercicio 2024")
    assert (got.sim, got.recibo, got.numero, got.total, got.exercicio) == (True, True, "12.34.56.78.90 - 12", "1.234,56", "2024")
    assert not one(K.tax_return, "Informe de Rendimentos, recibo de entrega, Receita Federal").sim
    car = one(K.vehicle, "AGENDAMENTO no Detran, placa ABC1D23, Chassi: 9BWZZZ377VT004251, renavam 12345678901")
    assert tuple(car) == ("Comprovante de Agendamento DETRAN", "ABC1D23", "12345678901", "9BWZZZ377VT004251")
    assert one(K.vehicle, "mandado de\nbusca e apreensao").tipo.startswith("Citação") and one(K.vehicle, "nada").tipo is None
