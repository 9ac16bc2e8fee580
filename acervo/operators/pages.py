"""Order-dependent work on a document's pages (WIN-1..9, SRC-6, SIG-13, ST-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import text as X

CONTRACTS = ["Contrato de Compra e Venda", "Contrato Particular de Compra e Venda de Imóvel", "Contrato"]
#: Words of a continued contract.
CONTRACT_TERMS = ["clausula", "cláusula", "foro", "testemunha", "cartorio", "cartório", "vendedor", "comprador", "instrumento", "eviccao", "evicção", "irrevogavel", "irrevogável"]
#: Class of a page that nothing names.
NOTHING = "Documento Diverso"
RETURN, RECEIPT = "Declaração de Imposto de Renda", "Recibo de Entrega da Declaração de Ajuste Anual"
CHEQUES = ["Folha de Cheque", "Talão de Cheques"]
#: Classes by precedence in a file of many pages; the first seven are academic.
PRIORITY = [
    "Diploma", "Certificado", "Histórico Escolar", "Declaração", "Ementa", "Dissertação", "Livro/Publicação",
    "Cartão CNPJ / Situação Cadastral", "Comprovante de Inscrição e de Situação Cadastral", "Currículo", "Declaração de Experiência Profissional",
    "Dossiê Veicular", "Certificado de Registro de Veículo (CRV)", "Certificado de Registro e Licenciamento de Veículo (CRLV)",
    "Autorização para Transferência de Propriedade de Veículo (ATPV)", "Comunicação de Venda ao DETRAN", "Laudo de Vistoria Veicular", "Guia de Remoção de Veículo",
    "Nota de Arrematação (Leilão)", "Comprovante de Agendamento DETRAN", "CNH", "RG", "CPF", "Certidão de Nascimento", "Certidão de Casamento", "Passaporte",
    "Contrato de Compra e Venda", "Contrato Particular de Compra e Venda de Imóvel", "Contrato", "Procuração", "Termo de Posse",
    "Recibo de Entrega da Declaração de Ajuste Anual", "Declaração de Imposto de Renda", "Informe de Rendimentos Financeiros",
    "Talão de Cheques", "Folha de Cheque", "Comprovante PIX", "Comprovante de Pagamento", "Boleto", "Boleto Bancário", "Nota Promissória", "Recibo",
]
ACADEMIC, PERSONAL = PRIORITY[:7], ["CNH", "RG", "CPF", "Certidão de Nascimento", "Certidão de Casamento", "Passaporte"]
#: Whose pages give the holder's ids, by precedence.
HOLDERS = {"cpf": ["identificacao", "academico", "financeiro", "outros"], "rg": ["identificacao", "academico", "outros"], "cnpj": ["profissional", "identificacao", "financeiro", "outros"], "curso": ["academico"]}


def split_pages(df: DataFrame, text_col: str = "texto") -> DataFrame:
    """SRC-6: page rows (md5, pagina, texto) from the marker lines of a text."""
    mark = r"(?:---|===) P[ÁA]GINA (\d+) (?:---|===)"
    numbers = F.transform(F.regexp_extract_all(text_col, F.lit(mark), 1), lambda n: n.cast("int"))
    bodies = F.transform(F.slice(F.split(text_col, mark), 2, 100_000_000), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return df.select("md5", F.explode(F.arrays_zip(numbers.alias("pagina"), bodies.alias("texto"))).alias("p")).select("md5", "p.pagina", "p.texto")


def first_per_key(df: DataFrame, key: str = "md5", order: str = "caminho") -> DataFrame:
    """WIN-1: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def _before(order: str = "pagina"):
    return Window.partitionBy("md5").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def stick_receipts(pages: DataFrame, read: Column) -> DataFrame:
    """SIG-11: a tax return page behind a receipt page is a receipt's, until another class comes between.

    read: whether a page's class was read off its own text as a tax return's (and not given by a rule).
    """
    follows = (F.col("tipo") == RETURN) & read
    # such pages take the state they find, so the state before one is the last other class
    state = F.last(F.when((F.col("tipo") != NOTHING) & ~F.coalesce(follows, F.lit(False)), F.col("tipo")), ignorenulls=True).over(_before())
    return pages.withColumn("tipo", F.when(follows & (state == RECEIPT), RECEIPT).otherwise(F.col("tipo")))


def carry_contracts(pages: DataFrame) -> DataFrame:
    """WIN-2: an untyped page with contract words takes the class of the last typed page before it, if that is a contract's."""
    typed = F.when(F.col("tipo") != NOTHING, F.col("tipo"))
    last = F.last(typed, ignorenulls=True).over(_before())
    goes_on = F.coalesce(typed.isNull() & last.isin(CONTRACTS) & X.any_of(F.lower(F.coalesce("texto", F.lit(""))), CONTRACT_TERMS), F.lit(False))
    return pages.withColumns({"tipo": F.when(goes_on, last).otherwise(F.col("tipo")), **({"dominio": F.when(goes_on, "juridico").otherwise(F.col("dominio"))} if "dominio" in pages.columns else {})})


def merge_returns(pages: DataFrame) -> DataFrame:
    """WIN-3: with a receipt page in the file, its tax return pages are receipts."""
    receipt = F.max(F.coalesce((F.col("tipo") == RECEIPT).cast("int"), F.lit(0))).over(Window.partitionBy("md5"))
    return pages.withColumn("tipo", F.when((receipt == 1) & (F.col("tipo") == RETURN), RECEIPT).otherwise(F.col("tipo")))


def _holders() -> list[Column]:
    def first(field: str, domains: list[str]) -> Column:
        rank = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("dominio"))
        return F.min_by(F.col(field), F.when((rank > 0) & X.present(field), F.struct(rank, F.col("pagina")))).alias(field)

    return [first(f, d) for f, d in HOLDERS.items()]


def holders(pages: DataFrame) -> DataFrame:
    """WIN-4: per file the holder's ids, by the precedence of the page's domain and then page order."""
    return pages.groupBy("md5").agg(*_holders())


def ordered(value: Column | str, order: str = "pagina") -> Column:
    """Distinct values of a group in order, nulls left out."""
    rows = F.array_sort(F.collect_list(F.when(X.col(value).isNotNull(), F.struct(F.col(order).alias("o"), X.col(value).alias("v")))))
    return F.array_distinct(F.transform(rows, lambda r: r["v"]))


def _seen() -> list[Column]:
    return [ordered("tipo").alias("tipos"), ordered("dominio").alias("dominios")]


def seen(pages: DataFrame) -> DataFrame:
    """WIN-9: classes and domains of a file in page order."""
    return pages.groupBy("md5").agg(*_seen())


def details(pages: DataFrame) -> DataFrame:
    """SIG-11: what the pages of a file tell on the way: distinct cheque numbers in page order, and the first of every other detail."""
    names = [f.name for f in pages.schema["detalhes"].dataType.fields if f.name != "numeros_cheque"]
    rows = F.array_sort(F.collect_list(F.struct(F.col("pagina").alias("o"), F.coalesce("detalhes.numeros_cheque", F.array().cast("array<string>")).alias("v"))))
    first = [F.min_by(F.col(f"detalhes.{n}"), F.when(F.col(f"detalhes.{n}").isNotNull(), F.col("pagina"))).alias(n) for n in names]
    return pages.groupBy("md5").agg(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"]))).alias("numeros_cheque"), *first)


def first_values(pages: DataFrame, fields: list[str]) -> DataFrame:
    """WIN-6: the first value of each field, and the distinct cheque numbers in order."""
    return pages.groupBy("md5").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pagina"))).alias(f) for f in fields], ordered("numero_cheque").alias("numeros_cheque"))


def _signs() -> list[Column]:
    """What a file's pages tell of its class.  Distinct values are counted in sets: they are a file's, and few; a count of its own would write every page out once for each."""
    rank = F.when(F.col("tipo").isNotNull(), F.nullif(F.array_position(F.array(*[F.lit(t) for t in PRIORITY]), F.col("tipo")), F.lit(0)))
    t, d = F.col("tipo"), F.col("dominio")
    car = d == "veicular"
    return [
        F.count("*").alias("n"), F.count_if(t.isin(CHEQUES)).alias("cheques"), F.size(F.collect_set("numero_cheque")).alias("numeros"),
        F.count_if(t.isin(ACADEMIC)).alias("academicas"), F.count_if(t.isin(PERSONAL)).alias("pessoais"),
        F.count_if(car).alias("carros"), F.size(F.collect_set(F.when(car, F.coalesce(t, F.lit(""))))).alias("tipos_carro"), F.min_by(t, F.when(car, F.col("pagina"))).alias("carro"),
        F.min_by(t, F.coalesce(rank, F.when(t.isNotNull(), 1000 + F.col("pagina")))).alias("tipo"),
        F.min_by(d, F.when(t.isNotNull(), F.struct(F.coalesce(rank, 1000 + F.col("pagina")), F.col("pagina")))).alias("dominio"),
        F.max(F.coalesce((d == "academico").cast("int"), F.lit(0))).alias("tem_academico"), F.min_by(d, "pagina").alias("primeiro"),
    ]


def _choice() -> Column:
    """(tipo_principal, dominio_principal) of _signs()."""
    book = ((F.col("cheques") >= 2) | (F.col("numeros") >= 2) | ((F.col("cheques") >= 1) & (F.col("n") > 1) & (F.col("cheques") / F.col("n") >= 0.5))) & (F.col("academicas") == 0)
    plain = (F.col("academicas") == 0) & (F.col("pessoais") == 0)
    both = lambda k, dom: F.struct(k.alias("tipo_principal"), dom.alias("dominio_principal"))
    money, wheels = F.lit("financeiro"), F.lit("veicular")
    fallback = F.coalesce(F.col("dominio"), F.when(F.col("tem_academico") == 1, "academico"), F.col("primeiro"), F.lit("academico"))
    return (
        F.when(book, both(F.lit("Talão de Cheques"), money))
        .when((F.col("cheques") == 1) & plain, both(F.lit("Folha de Cheque"), money))
        .when((F.col("carros") >= 2) & (F.col("tipos_carro") >= 2) & (F.col("academicas") == 0), both(F.lit("Dossiê Veicular"), wheels))
        .when((F.col("carros") >= 1) & plain, both(F.col("carro"), wheels))
        .otherwise(both(F.col("tipo"), fallback))
    )


def principal(pages: DataFrame) -> DataFrame:
    """WIN-5: principal class and domain of every file."""
    return pages.groupBy("md5").agg(*_signs()).select("md5", _choice().alias("c")).select("md5", "c.*")


def longest_run(lines: Column) -> Column:
    """WIN-7: length of the longest run of equal consecutive lines longer than 3 letters, case aside."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        low = F.lower(x)
        run = F.when((low == a["last"]) & (F.length(x) > 3), a["run"] + 1).otherwise(1)
        return F.struct(low.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(lines, start, step)["best"]


def sanitize_transcript(s: Column | str) -> Column:
    """SC-23: null for texts under 20 letters and for transcripts stuck in a loop."""
    text = F.trim(X.col(s))
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    long = F.filter(F.transform(lines, lambda x: F.lower(x)), lambda x: F.length(x) > 4)
    # sorted, equal lines stand together: their longest run is the most frequent line
    most = F.aggregate(F.array_sort(long), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(x == a["last"], a["run"] + 1).otherwise(1)).alias("best")))["best"]
    bad = (F.length(text) < 20) | (F.size(lines) == 0) | (longest_run(lines) >= 4) | ((most >= 5) & (most / F.size(lines) > 0.35))
    return F.when(~bad, text)


def merge_dossier(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """SIG-13: principal class and domain, the holder's ids where the row has none, and the classes seen, first the principal one."""
    names = [*[f"_{f}" for f in HOLDERS], "tipos", "dominios"]
    told = pages.groupBy("md5").agg(*_signs(), *[h.alias(f"_{f}") for f, h in zip(HOLDERS, _holders())], *_seen())
    found = told.select("md5", _choice().alias("c"), *names).select("md5", "c.*", *names)
    out = docs.join(found.hint("merge"), "md5", "left")
    kinds = F.array_distinct(F.filter(F.concat(F.array(F.coalesce("tipo_principal", "tipo_documento")), F.coalesce("tipos", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    given = {f: F.coalesce(X.nonblank(f), F.col(f"_{f}")) for f in HOLDERS if f in docs.columns}
    return out.withColumns({**given, "tipo_documento": F.coalesce("tipo_principal", "tipo_documento"), "dominio": F.coalesce("dominio_principal", "dominio"), "todos_tipos": kinds}).drop("tipos", "dominios", "tipo_principal", "dominio_principal", *[f"_{f}" for f in HOLDERS])


def reclassify_pages(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """ST-11: page rows with the classes of changes (md5, pagina, tipo) put in."""
    new = changes.select("md5", "pagina", F.col("tipo").alias("_novo"))
    return pages.join(new, ["md5", "pagina"], "left").withColumn("tipo", F.coalesce("_novo", "tipo")).drop("_novo")
