"""Scalar functions on text, ids and money as native Column expressions (SC-1..13, 25, 26)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics and their base letters, from the Unicode decompositions up to U+017F.
_MARKED = [c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
_MARKED = "".join(_MARKED)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_marks(s: Column | str) -> Column:
    """Letters without their diacritics."""
    return F.translate(F.regexp_replace(col(s), r"\p{Mn}", ""), _MARKED, _BASES)


def fold(s: Column | str) -> Column:
    """SC-1: lower case, no diacritics, trimmed; null becomes the empty text."""
    return F.trim(strip_marks(F.lower(F.coalesce(col(s), F.lit("")))))


def blank(s: Column | str) -> Column:
    """Whether a text is null, empty or white space only."""
    return F.trim(F.coalesce(col(s), F.lit(""))) == ""


def present(s: Column | str) -> Column:
    return ~blank(s)


def nonblank(s: Column | str) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(col(s)), F.lit(""))


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def digits(s: Column | str) -> Column:
    """SC-2."""
    return F.regexp_replace(F.coalesce(col(s), F.lit("")), "[^0-9]", "")


def _masked(s: Column, size: int, pieces: list[tuple[int, int]], marks: list[str]) -> Column:
    d = digits(s)
    parts = [x for (a, n), m in zip(pieces, [*marks, ""]) for x in (F.substring(d, a, n), F.lit(m))]
    return F.when(s.isNull() | (s == ""), F.lit(None)).when(F.length(d) == size, F.concat(*parts)).otherwise(F.trim(s))


def format_cpf(s: Column | str) -> Column:
    """SC-3: 11 digits as 000.000.000-00, anything else trimmed."""
    return _masked(col(s), 11, [(1, 3), (4, 3), (7, 3), (10, 2)], [".", ".", "-"])


def format_cnpj(s: Column | str) -> Column:
    """SC-3: 14 digits as 00.000.000/0000-00, anything else trimmed."""
    return _masked(col(s), 14, [(1, 2), (3, 3), (6, 3), (9, 4), (13, 2)], [".", ".", "/", "-"])


def format_id(s: Column | str) -> Column:
    """SC-3: a cpf or cnpj mask by the number of digits, null for other lengths."""
    return F.when(F.length(digits(s)) == 11, format_cpf(s)).when(F.length(digits(s)) == 14, format_cnpj(s))


def _mod11(d: Column, weights: list[int]) -> Column:
    """Check digit for the leading digits of d: 11 less the weighted sum mod 11, 10 and 11 count as 0."""
    total = reduce(lambda a, b: a + b, (F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _valid(s: Column, size: int, first: list[int], second: list[int]) -> Column:
    d = digits(s)
    good = (_mod11(d, first) == F.substring(d, size - 1, 1).try_cast("int")) & (_mod11(d, second) == F.substring(d, size, 1).try_cast("int"))
    return F.when((F.length(d) != size) | d.rlike(r"^(\d)\1*$"), False).otherwise(F.coalesce(good, F.lit(False)))


def valid_cpf(s: Column | str, strict: bool = False) -> Column:
    """SC-4: both check digits hold and the digits are not all equal; strict also wants the mask."""
    c = col(s)
    good = _valid(c, 11, list(range(10, 1, -1)), list(range(11, 1, -1)))
    return F.coalesce(good & c.rlike(r"^\d{3}\.\d{3}\.\d{3}-\d{2}$"), F.lit(False)) if strict else good


def valid_cnpj(s: Column | str, strict: bool = False) -> Column:
    """SC-5."""
    c, w = col(s), [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    good = _valid(c, 14, w, [6, *w])
    return F.coalesce(good & c.rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$"), F.lit(False)) if strict else good


def parse_money(s: Column | str) -> Column:
    """SC-6: Brazilian or plain money text as a double, 0 where it cannot be read."""
    kept = F.regexp_replace(F.coalesce(col(s), F.lit("")), "[^0-9,.]", "")
    plain = F.when(kept.contains(",") & kept.contains("."), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(kept.contains(","), F.replace(kept, F.lit(","), F.lit("."))).otherwise(kept)
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def format_brl(x: Column | str) -> Column:
    """SC-7: R$ 1.234,50."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(col(x), 2), ",.", ".,"))


def extract_year(s: Column | str, low: int | None = None, high: int | None = None) -> Column:
    """SC-8: the first 19xx or 20xx as an int; null without one or beyond low..high."""
    y = F.regexp_extract(F.coalesce(col(s), F.lit("")), r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")
    return y if low is None else F.when(y.between(low, high), y)


def extract_hours(s: Column | str) -> Column:
    """SC-9: the number before h, hr or hora, else the first number; valid above 0 and below 20000."""
    t = F.lower(F.coalesce(col(s), F.lit("")))
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)\s*(?:horas?|hrs?|h)\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit(""))).try_cast("int")
    return F.when((n > 0) & (n < 20000), n)


# Words kept in lower case inside a title, and acronyms kept in upper case.
CONNECTIVES = "de da do das dos e em para com no na nos nas a o as os".split()
ACRONYMS = (
    "FIVAR FAB CETEC CTEC CEITEC CEIC CEIT CEEC FACI FAD FAP UESC IASES UGF SENAC UNIFTB UNIFENAS UNIFIL FABRANI FABAVI "
    "NEJA DETRAN CEUFTB UNIP USP UFRJ UFBA UFMG UNIFESP PUC UNIDERP UNICIAN IFES IFSP MEC INEP"
).split()


def title_pt(s: Column | str) -> Column:
    """SC-10: Portuguese title case; a trailing (acronym) goes to upper case."""
    text = F.trim(F.coalesce(col(s), F.lit("")))
    tail = F.regexp_extract(text, r"\s*\(([A-Za-z0-9\s\-]+)\)$", 1)
    body = F.when(tail != "", F.regexp_replace(text, r"\s*\([A-Za-z0-9\s\-]+\)$", "")).otherwise(text)

    def one(w: Column, i: Column) -> Column:
        low, up = F.lower(w), F.upper(w)
        short = (F.length(w) <= 5) & w.rlike(r"^\p{Lu}+$")
        return F.when(up.isin(ACRONYMS), up).when((i > 0) & low.isin(CONNECTIVES), low).when(w.startswith("(") & w.endswith(")"), up).when(short & ~low.isin(CONNECTIVES), up).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))

    words = F.transform(F.filter(F.split(body, r"\s+"), lambda w: w != ""), one)
    return F.concat(F.array_join(words, " "), F.when(tail != "", F.concat(F.lit(" ("), F.upper(F.trim(tail)), F.lit(")"))).otherwise(""))


# Names that mean "no institution".
NO_INSTITUTION = [
    "null", "none", "nao informada", "nao informado", "não informada", "não informado", "n/a", "desconhecida", "desconhecido",
    "sem instituicao", "universidade", "faculdade", "instituicao", "instituição",
]
# Canonical institutions as alternatives of keyword sets, all of which must be in the folded name.
INSTITUTION_RULES: list[tuple[list[list[str]], str]] = [
    ([["vale do rio"]], "Faculdades Integradas Vale do Rio Verde (FIVAR)"),
    ([["fivar", "itarare"]], "Faculdades Integradas de Itararé"),
    ([["fivar"]], "Faculdades Integradas Vale do Rio Verde (FIVAR)"),
    ([["uniftb"], ["tobias barreto"], ["ceuftb"]], "Faculdade UNIFTB"),
    ([[a, b] for a in ("alfa", "alffa", "afpa", "fauldaffe", "fauldae") for b in ("brasil", "fab")], "Faculdade Alffa do Brasil (FAB)"),
    ([[a, "capacitacao"] for a in ("cetec", "ctec", "ceitec", "ceic", "ceit", "ceec")] + [["centro tecnico de capacitacao"]], "Centro Técnico de Capacitação (CETEC)"),
    ([["impacto"], ["impracto"], ["faci", "faculdade"]], "Faculdades Impactos Brasil (FACI)"),
    ([["domini"], ["dominus"]], "Faculdade Dominius (FAD)"),
    ([[a, b] for a in ("parana", "jarani") for b in ("faculdade", "fap")], "Faculdade Paraná (FAP)"),
    ([["itarare"], ["itarae"]], "Faculdades Integradas de Itararé"),
    ([["famart"]], "Faculdade Famart"),
    ([["santa cruz", "universidade"], ["santa cruz", "uesc"]], "Universidade Estadual de Santa Cruz (UESC)"),
    ([["iases"], ["socioeducativo"]], "Instituto de Atendimento Socioeducativo do Espírito Santo (IASES)"),
    ([["gama filho"]], "Universidade Gama Filho (UGF)"),
    ([["wenceslau braz"]], "Faculdade de Ciências de Wenceslau Braz"),
    ([["scardua"], ["scarda"]], "Scardua Educacional"),
    ([["sao geraldo"]], "Faculdade São Geraldo (Multivix)"),
    ([["faculdade do v ale"], ["faculdade do vale"]], "Faculdade do Vale"),
]


def normalize_institution(s: Column | str, rules=INSTITUTION_RULES) -> Column:
    """SC-11: one canonical 'Name (ACRONYM)' for the spellings of an institution; null for null-like names."""
    raw = F.trim(col(s))
    clean = F.regexp_replace(raw, r"[‐-―−]", "-")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, "[\"'`´]", ""), r"\s+", " "))
    clean = F.trim(F.regexp_replace(clean, r"(?i)\b(LTDA|S/?A|EIRELI|ME|EPP)\b\.?", ""))
    clean = F.trim(F.regexp_replace(clean, r"\s*-\s*$", ""))
    return F.when(blank(raw) | F.lower(raw).isin(NO_INSTITUTION), F.lit(None)).otherwise(let(clean, lambda c: F.coalesce(_canonical(c, rules), _shaped(c))))


def _canonical(clean: Column, rules) -> Column:
    if not rules:
        return F.lit(None).cast("string")

    def known(folded: Column) -> Column:
        hit = lambda sets: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (folded.contains(w) for w in ws)) for ws in sets))
        return F.coalesce(*[F.when(hit(sets), F.lit(name)) for sets, name in rules], F.when(F.regexp_replace(folded, "[^a-z0-9]", "").isin("fab", "faculdadefab"), F.lit("Faculdade Alffa do Brasil (FAB)")))

    return let(fold(clean), known)


def _shaped(clean: Column) -> Column:
    """'ACRONYM - Name', 'Name - ACRONYM', '(ACRONYM) Name' and 'Name (ACRONYM)' as (name, acronym), then as one text."""
    part = lambda p, i: F.trim(F.regexp_extract(clean, p, i))
    first, last = r"^([A-Z0-9]{2,8})\s*[-–—:/|]\s*(.+)$", r"^(.+?)\s*[-–—:/|]\s*([A-Z0-9]{2,8})$"
    front, back = r"^\((.+?)\)\s*(.+)$", r"^(.+?)\s*\(([A-Za-z0-9\s\-]+)\)$"
    both = lambda name, short: F.struct(name.alias("name"), short.alias("short"))
    found = F.when(clean.rlike(first), both(F.regexp_replace(part(first, 2), r"^[-–—:/|]\s*", ""), part(first, 1))).when(clean.rlike(last), both(part(last, 1), part(last, 2)))
    found = found.when(clean.rlike(front) & (F.length(part(front, 1)) <= 8), both(part(front, 2), part(front, 1))).when(clean.rlike(back) & (F.length(part(back, 2)) <= 8), both(part(back, 1), part(back, 2)))
    found = found.otherwise(both(clean, F.lit("")))
    return let(found, lambda x: F.concat(title_pt(x["name"]), F.when(x["short"] != "", F.concat(F.lit(" ("), F.upper(x["short"]), F.lit(")"))).otherwise("")))


# Academic levels by keywords in the folded text, first match wins.
LEVELS = [
    (["stricto", "mestrado", "doutorado"], "Pós-Graduação Stricto Sensu (Mestrado/Doutorado)"),
    (["lato sensu", "especializacao", "mba", "pos-graduacao", "pos graduacao"], "Pós-Graduação Lato Sensu (Especialização/MBA)"),
    (["graduacao", "superior", "bacharel", "licenciatura", "tecnologo"], "Graduação / Curso Superior"),
    (["tecnico", "profissionalizante"], "Curso Técnico / Profissionalizante"),
    (["extensao", "aperfeicoamento", "capacitacao"], "Curso de Extensão / Aperfeiçoamento"),
    (["basica", "medio", "fundamental"], "Educação Básica"),
]
NO_LEVEL = "Não identificada"


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds any of the literal words: one combined pattern per family."""
    import re

    return text.rlike("|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words))


def cascade(text: Column, table: list[tuple[list[str], str]], default: Column | str | None) -> Column:
    """The label of the first keyword family that the text holds."""
    return F.coalesce(*[F.when(any_of(text, words), F.lit(label)) for words, label in table], default if isinstance(default, Column) else F.lit(default))


def academic_level(s: Column | str) -> Column:
    """SC-12."""
    return cascade(fold(s), LEVELS, NO_LEVEL)


def sanitize_part(s: Column | str, default: str = "Nao_Informado", size: int = 60) -> Column:
    """SC-13: a text that can stand in a path."""
    t = F.regexp_replace(F.trim(F.coalesce(col(s), F.lit(""))), r'[\\/*?:"<>|\r\n\t ]', "_")
    t = F.regexp_replace(F.substring(t, 1, size), r"^[._]+|[._]+$", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def normalize_for_compare(s: Column | str) -> Column:
    """SC-25: lower case, anything but word characters becomes one space."""
    t = F.regexp_replace(F.lower(F.coalesce(col(s), F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def highlight(s: Column | str, term: str) -> tuple[Column, Column]:
    """SC-26: the text with every occurrence of a literal term marked, and how many there are; case does not count."""
    import re

    pattern = "(?iu)" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    return F.regexp_replace(col(s), f"({pattern})", "<mark>$1</mark>"), F.regexp_count(col(s), F.lit(pattern))
