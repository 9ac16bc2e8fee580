"""Keyword cascades over document classes (SC-28..32, FIL-9..14) from data tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions import text as X

# Domains by keywords in the lower-cased class of a learned rule (SC-29), first match wins.
RULE_DOMAINS = [
    ("crv crlv atpv veiculo veículo veicular vistoria detran senatran denatran remocao remoção arrematacao arrematação leilao leilão guincho transito trânsito".split(), "veicular"),
    ("recibo promiss boleto cheque pix pagamento extrato fatura darf ted doc".split(), "financeiro"),
    ("contrato procur posse estatuto termo citação citacao mandado".split(), "juridico"),
    ("rg cpf cnh identidade certid passaporte eleitor".split(), "identificacao"),
    ([*"trabalho ctps cnpj lattes curriculo currículo".split(), "registro profissional"], "profissional"),
    ("diploma certificado histórico historico ementa atestado".split(), "academico"),
]
# Fixed values for rows without domain (SC-30).
NOT_FINANCIAL = "inscrição inscricao situação situacao cnpj residência residencia matrícula matricula rendimentos votação votacao".split()
VEHICLE = "crv crlv atpv veiculo veículo veicular vistoria detran senatran denatran remocao remoção arrematacao arrematação leilao leilão guincho".split()
FINANCIAL = ["pix", "comprovante de pagamento", "comprovante pix", "recibo de pagamento", "boleto"]
PROFESSIONAL = ["situação cadastral", "situacao cadastral", "cnpj", "currículo", "curriculo", "experiência profissional", "experiencia profissional"]
PERSONAL = "rg cnh identidade cpf certidão certidao".split()
LEGAL = "contrato procuração procuracao posse juridico".split()
# Categories of a class (FIL-12) by keywords in its folded name.
CATEGORIES = [
    (["curriculo", "experiencia profissional", "lattes", "carteira de trabalho", "ctps", "situacao cadastral", "registro profissional"], "Carreira & Profissional"),
    ("rg cnh cpf identidade habilitacao certidao eleitoral passaporte nascimento casamento reservista".split(), "Identificação & Pessoal"),
    (["pix", "pagamento", "extrato", "banco", "bancario", "nota fiscal", "fatura", "recibo", "boleto"], "Financeiro"),
    (["contrat", "convenio", "responsabilidade", "portaria", "resolucao", "diario oficial", "termo", "procuracao", "estatuto"], "Jurídico & Normativo"),
    ("recurso relatorio cadastro preparatorio promocional processual oficio memorando".split(), "Processual & Administrativo"),
    ([*"diploma certificado historico declaracao ementa dissertacao livro publicacao didatico instrucional biblioteca aluno ensino academico curso graduacao pos-graduacao modulo".split(), "desenvolvimento institucional"], "Produtos Acadêmicos"),
]
# Umbrella tags (FIL-11): domains, and keywords in the folded classes.
MACROS = {
    "academicos": (["academico"], ["diploma", "certificado", "historico escolar", "declaracao", "ementa", "conteudo programatico", "dissertacao", "livro", "publicacao", "didatico", "instrucional", "biblioteca", "aluno", "ensino", "academico", "curso", "graduacao", "pos-graduacao", "modulo", "plano de desenvolvimento"]),
    "profissional": (["profissional"], ["curriculo", "experiencia profissional", "lattes", "carteira de trabalho", "ctps", "situacao cadastral", "cnpj", "cartao cnpj", "receita federal", "registro profissional", "crf", "crm", "oab", "crea"]),
    "identificacao": (["identificacao", "pessoal"], "rg cpf cnh identidade habilitacao certidao eleitoral passaporte nascimento casamento reservista residencia".split()),
    "financeiro": (["financeiro"], ["pix", "pagamento", "extrato", "banco", "bancario", "nota fiscal", "fatura", "recibo", "boleto"]),
    "juridico": (["juridico", "normativo", "legal"], ["contrat", "convenio", "responsabilidade", "portaria", "resolucao", "diario oficial", "termo", "procuracao", "estatuto", "parecer"]),
}
EXTENSIONS = {"word": [".docx", ".doc", ".odt", ".rtf"], "image": [".png", ".jpg", ".jpeg", ".webp"], "text": [".txt"]}


def type_to_domain(t: Column | str, default: Column | str = "academico") -> Column:
    """SC-29."""
    return X.cascade(F.lower(F.coalesce(X.col(t), F.lit(""))), RULE_DOMAINS, default)


def default_domain(t: Column | str, value: Column | str | None = None) -> Column:
    """SC-30: the domain of a row that has none, from its class and whether it has a value."""
    low = F.lower(F.coalesce(X.col(t), F.lit("")))
    paid = X.any_of(low, FINANCIAL) | (X.present(value) if value is not None else F.lit(False))
    return F.when(X.any_of(low, VEHICLE), "veicular").when(~X.any_of(low, NOT_FINANCIAL) & paid, "financeiro").when(X.any_of(low, PROFESSIONAL), "profissional").when(X.any_of(low, PERSONAL), "identificacao").when(X.any_of(low, LEGAL), "juridico").otherwise("academico")


# Fixed values for the consolidated domain (SC-31): what a class is called that proves a payment, does not, or belongs to a field.
UNKNOWN = ["não identificado", "nao identificado", "outro", "não informado", "nao informado"]
PAID = ["nota promissória", "nota promissoria", "recibo", "comprovante de pagamento", "comprovante de transferência", "comprovante de transferencia", "comprovante bancário", "comprovante bancario", "boleto", "cheque", "talao", "talão", "informe de rendimentos", "imposto de renda", "ajuste anual"]
NO_PAYMENT = ["inscrição", "inscricao", "situação cadastral", "situacao cadastral", "cnpj", "residência", "residencia", "matrícula", "matricula", "votação", "votacao"]
INCOME = ["informe de rendimentos", "rendimentos financeiros"]
ACADEMIC = ["diploma", "certificado", "histórico", "historico", "declaração", "declaracao", "ementa", "dissertação", "dissertacao", "tese", "graduação", "graduacao", "pós-graduação", "pos-graduacao", "especialização", "especializacao"]
COMPANY = ["situação cadastral", "situacao cadastral", "cartão cnpj", "cartao cnpj", "cartão do cnpj", "cartao do cnpj", "cadastro nacional da pessoa"]
CAREER = ["currículo", "curriculo", "experiência profissional", "experiencia profissional", "lattes", "ctps", "carteira de trabalho"]
IDENTITY = ["rg", "cnh", "identidade", "cpf", "certidão", "certidao", "eleitor", "passaporte"]
LAW = ["contrato", "procuração", "procuracao", "posse", "juridico", "petição", "peticao"]
GIVEN = ["academico", "financeiro", "identificacao", "juridico", "profissional", "outro"]
HANDWRITTEN = ["preenchido a mão", "preenchido à mão", "de próprio punho", "de proprio punho"]
HAND_KINDS = ["manuscrito", "preenchido a mão", "preenchido à mão", "proprio punho", "próprio punho", "recibo manual", "nota promissória manual"]


def _low(c: Column | str) -> Column:
    return F.lower(F.coalesce(X.col(c), F.lit("")))


def consolidate_domain(kind: Column, domain: Column, told_kind: Column, told_domain: Column, certain: Column, pix: Column, payment: Column, value: Column) -> Column:
    """SC-31: (tipo, dominio) of a document.

    kind and domain are those found so far, told_kind and told_domain those given at first.
    certain: a slip, cheque, tax return or income report; pix: a genuine PIX; payment: the kind of
    another payment its text tells, or null; value: its amount.  The first that holds decides:
    certain, evidence of a payment (none for classes that only look like it), academic,
    company, identity and legal classes, the domain found, "academico".  Unnamed payments and
    company cards get a name.
    """
    k, told = _low(kind), _low(told_kind)
    unnamed = X.blank(kind) | k.isin(*UNKNOWN)
    no = F.coalesce(X.any_of(k, NO_PAYMENT) & ~X.any_of(k, INCOME), F.lit(False))
    paid = pix | payment.isNotNull() | X.any_of(k, PAID) | X.present(value) | F.coalesce(domain == "financeiro", F.lit(False))
    academic = X.any_of(told, ACADEMIC) | F.coalesce(told_domain == "academico", F.lit(False))
    company = X.any_of(told, COMPANY) | (F.coalesce(told_domain == "profissional", F.lit(False)) & X.any_of(told, ["cnpj", "cadastral"]))
    both = lambda t, d: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("tipo"), (d if isinstance(d, Column) else F.lit(d)).alias("dominio"))
    name = F.when(pix, "Comprovante PIX").otherwise(F.coalesce(payment, F.lit("Recibo de Pagamento")))
    return (
        F.when(certain, both(kind, "financeiro"))
        .when(~no & paid, both(F.when(unnamed, name).otherwise(kind), "financeiro"))
        .when(academic, both(kind, "academico"))
        .when(company | X.any_of(k, CAREER), both(F.when(unnamed, "Cartão CNPJ / Situação Cadastral").otherwise(kind), "profissional"))
        .when(X.any_of(k, IDENTITY), both(kind, "identificacao"))
        .when(X.any_of(k, LAW), both(kind, "juridico"))
        .otherwise(both(kind, F.when(domain.isin(*GIVEN), domain).otherwise("academico")))
    )


def is_handwritten(t: Column | str, types: Column | str) -> Column:
    """SC-32: a class that tells of handwriting."""
    every = F.concat_ws(" ", X.col(t), X.col(types))
    return X.any_of(F.lower(every), ["manuscrito", "manual", "mão", "mao"])


def written_by_hand(flag: Column | str, t: Column | str, *texts: Column | str) -> Column:
    """SC-32: by a given flag (true, 1, sim, yes), by the class, or by words of any of the texts."""
    said = F.lower(F.trim(F.coalesce(X.col(flag).cast("string"), F.lit("")))).isin("true", "1", "sim", "yes")
    found = said | X.any_of(_low(t), HAND_KINDS)
    for x in texts:
        found = found | X.any_of(_low(x), HANDWRITTEN)
    return found


def with_handwritten(types: Column | str, yes: Column) -> Column:
    """SC-32: the tag appended where no class tells it already."""
    c = F.coalesce(X.col(types), F.array().cast("array<string>"))
    told = F.exists(c, lambda t: X.any_of(_low(t), ["manuscrito", "mão", "mao"]))
    return F.when(yes & ~told, F.array_append(c, F.lit("Manuscrito"))).otherwise(c)


def page_terms(t: Column | str, text: Column | str) -> Column:
    """SC-28: characteristic terms of a page: its class name if the text has it, without accents too, anchor phrases of its family, and the first header line."""
    kind, body = F.lower(F.trim(X.col(t))), F.lower(F.coalesce(X.col(text), F.lit("")))
    plain = X.strip_marks(kind)
    # Anchor phrases by family.
    anchors = {"diploma": ["confere o grau", "colação de grau"], "certificado": ["certificamos que"], "hist": ["histórico escolar", "disciplinas cursadas"], "recibo": ["recebi de", "recebemos de"], "contrato": ["as partes", "cláusula"], "pix": ["chave pix", "comprovante pix"], "boleto": ["linha digitável", "recibo do pagador"]}
    family = [F.when(kind.contains(k) & body.contains(a), F.lit(a)) for k, both in anchors.items() for a in both]
    header = F.trim(F.element_at(F.filter(F.split(F.coalesce(X.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1))
    head = F.when(F.length(header).between(5, 60), F.lower(header))
    return F.array_distinct(F.filter(F.array(F.when(body.contains(kind) & (kind != ""), kind), F.when(body.contains(plain) & (plain != ""), plain), *family, head), lambda x: x.isNotNull()))


def format_class(ext: Column | str, name: Column | str) -> Column:
    """FIL-9: word, image, text or pdf, by extension or else by the end of the file name."""
    e, n = F.lower(F.coalesce(X.col(ext), F.lit(""))), F.lower(F.coalesce(X.col(name), F.lit("")))
    return F.coalesce(*[F.when(e.isin(*x) | n.rlike("(" + "|".join(f"\\{y}" for y in x) + ")$"), F.lit(k)) for k, x in EXTENSIONS.items()], F.lit("pdf"))


def tag_category(t: Column | str) -> Column:
    """FIL-12."""
    f = X.fold(t)
    return F.when(f.isin("", "nao identificado", "outro", "documento diverso"), "Outros").otherwise(X.cascade(f, CATEGORIES, "Outros"))


def macro_tag(tag: str, types: Column | str, domain: Column | str, cnpj: Column | str | None = None) -> Column:
    """FIL-11: whether a row falls under an umbrella tag, by domain, by any of its classes, or (company tag) by a cnpj."""
    domains, words = MACROS[tag]
    hit = F.coalesce(F.lower(F.trim(X.col(domain))).isin(domains), F.lit(False)) | F.exists(X.col(types), lambda t: X.any_of(X.fold(t), words))
    return hit | X.present(cnpj) if tag == "profissional" and cnpj is not None else hit


def recalculated_domains(domain: Column | str, types: Column | str) -> Column:
    """FIL-14: the main domain and one domain for each class."""
    each = F.transform(X.col(types), lambda t: type_to_domain(t))
    return F.array_distinct(F.concat(F.array(F.coalesce(X.nonblank(domain), F.lit("academico"))), each))
