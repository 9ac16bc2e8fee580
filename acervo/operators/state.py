"""State changes of the registry as joins and projections (ST-1..15, JOI-2..4, 8..10, SRC-4, 9, 10, DUP-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import classes as C
from acervo.functions import text as X
from acervo.operators.filters import distinct_folded

UNTYPED = ["", "não identificado", "nao identificado", "outro", "não informado", "nao informado"]
#: Columns that keep their old value when an update brings null.
KEEP = [
    "nome_arquivo", "caminho_relativo", "extensao", "data_modificacao", "autor", "beneficiario", "cpf", "rg", "cnpj", "curso", "natureza_curso", "carga_horaria",
    "faculdade", "valor_monetario", "data", "dublin_core", "dc_title", "dc_subject", "dc_creator_tool", "dossie_id",
]


def plan(files: DataFrame, registry: DataFrame, mode: str = "incremental") -> DataFrame:
    """ST-1, JOI-2: one row per md5 with what to do: new, rerun, or done.

    Approved rows are done in every mode but force; incremental runs everything again that did
    not succeed; reprocess_ocr takes OCR errors, and unidentified classes or bad cpfs not tried yet.
    """
    own = files.withColumn("_n", F.row_number().over(Window.partitionBy("md5").orderBy("caminho"))).filter("_n = 1").drop("_n")
    known = registry.select("md5", "status", "status_conferencia", F.lower(F.trim(F.coalesce("tipo_documento", F.lit("")))).alias("t"), "cpf", "erro", "tentativa_ocr_llm", F.lit(True).alias("known"))
    both = own.join(known, "md5", "left")
    failed = F.coalesce((F.col("status") == "erro") & F.col("erro").contains("OCR"), F.lit(False))
    unclear = (F.col("t").isin(UNTYPED) | (X.present("cpf") & ~X.valid_cpf("cpf", True))) & ~F.coalesce("tentativa_ocr_llm", F.lit(False))
    again = {"force": F.lit(True), "incremental": F.coalesce(F.col("status") != "sucesso", F.lit(True)), "reprocess_ocr": failed | unclear}[mode]
    approved = F.coalesce(F.col("status_conferencia") == "aprovado", F.lit(False)) if mode != "force" else F.lit(False)
    return both.select("md5", "caminho", F.when(F.col("known").isNull(), "novo").when(approved, "pronto").when(again, "refazer").otherwise("pronto").alias("acao"))


def upsert(registry: DataFrame, batch: DataFrame, keep: list[str] = KEEP, order: str | None = None) -> DataFrame:
    """ST-2, JOI-10: insert or update by md5; `keep` columns hold their old value against null, all others are overwritten.

    Several rows of one md5 in a batch are folded first, in the given order.
    """
    cols = [c for c in registry.columns if c != "md5"]
    if order is not None:
        row = F.struct(order)
        batch = batch.groupBy("md5").agg(*[(F.max_by(c, F.when(F.col(c).isNotNull(), row)) if c in keep else F.max_by(c, row)).alias(c) for c in cols])
    old, new = registry.alias("o"), batch.select("md5", *cols, F.lit(True).alias("_new")).alias("n")
    value = lambda c: F.when(F.col("n._new").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.col(f"n.{c}")).alias(c)
    return old.join(new, F.col("o.md5") == F.col("n.md5"), "full_outer").select(F.coalesce("o.md5", "n.md5").alias("md5"), *[value(c) for c in cols])


def set_review(registry: DataFrame, chosen: DataFrame, status: str, note: str | None = None, at: str | None = None) -> DataFrame:
    """ST-3: review state (and note, time) of the rows whose md5 is in chosen."""
    hit = chosen.select("md5").distinct().withColumn("_hit", F.lit(True))
    new = {"status_conferencia": F.lit(status), "observacoes_conferencia": F.lit(note), "conferido_em": F.lit(at)}
    out = registry.join(hit, "md5", "left")
    return out.withColumns({c: F.when(F.col("_hit") & v.isNotNull(), v).otherwise(F.col(c)) for c, v in new.items() if c in registry.columns}).drop("_hit")


def retag(registry: DataFrame, chosen: DataFrame, *, tipo: str | None = None, dominio: str | None = None, faculdade: str | None = None, status: str | None = None) -> DataFrame:
    """ST-4: new class, domain, institution or review state for chosen rows; blank changes nothing."""
    hit = chosen.select("md5").distinct().withColumn("_hit", F.lit(True))
    named = X.normalize_institution(F.lit(faculdade)) if faculdade else F.lit(None)
    new = {"tipo_documento": F.lit(tipo or None), "dominio": F.lit(dominio or None), "faculdade": named, "status_conferencia": F.lit(status or None), "todos_tipos": F.array(F.lit(tipo)) if tipo else F.lit(None)}
    return registry.join(hit, "md5", "left").withColumns({c: F.when(F.col("_hit") & v.isNotNull(), v).otherwise(F.col(c)) for c, v in new.items() if c in registry.columns}).drop("_hit")


def set_flags(registry: DataFrame, flags: DataFrame) -> DataFrame:
    """ST-5: integrity flags from a table (md5, eh_nativo_digital, tem_assinatura_digital)."""
    names = ["eh_nativo_digital", "tem_assinatura_digital"]
    new = flags.select("md5", *[F.col(c).alias(f"_{c}") for c in names])
    return registry.join(new, "md5", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*[f"_{c}" for c in names])


def upsert_rules(rules: DataFrame, batch: DataFrame) -> DataFrame:
    """ST-6: rules by (lower(termo_chave), lower(campo_alvo)); known ones keep their id, new ones get the next."""
    key = [F.lower("termo_chave").alias("_t"), F.lower("campo_alvo").alias("_c")]
    rest = [c for c in rules.columns if c != "id"]
    old, new = rules.select("*", *key).alias("o"), batch.select(*rest, *key).dropDuplicates(["_t", "_c"]).alias("n")
    both = old.join(new, (F.col("o._t") == F.col("n._t")) & (F.col("o._c") == F.col("n._c")), "full_outer")
    merged = both.select("o.id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])
    last = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # rules are taught by people: a small table, numbered in one place
    fresh = merged.filter("id is null").drop("id").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.row_number().over(Window.orderBy("termo_chave", "campo_alvo"))).drop("last")
    return merged.filter("id is not null").unionByName(fresh.select(merged.columns))


def delete_rule(rules: DataFrame, rule: int) -> DataFrame:
    return rules.filter(F.col("id") != rule)


def mark_duplicates(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """ST-7: duplicata_de and similarity from (canonico_md5, duplicata_md5, similaridade)."""
    new = pairs.groupBy(F.col("duplicata_md5").alias("md5")).agg(F.min("canonico_md5").alias("_de"), F.max("similaridade").alias("_s"))
    out = registry.join(new, "md5", "left").withColumn("duplicata_de", F.coalesce("_de", "duplicata_de"))
    return (out.withColumn("similaridade_duplicata", F.coalesce("_s", "similaridade_duplicata")) if "similaridade_duplicata" in registry.columns else out).drop("_de", "_s")


def resolve_duplicates(registry: DataFrame, chosen: DataFrame, confirm: bool) -> DataFrame:
    """ST-7: confirmed rows are reviewed as duplicado, discarded ones lose their mark."""
    hit = registry.join(chosen.select("md5").distinct().withColumn("_hit", F.lit(True)), "md5", "left")
    change = {"status_conferencia": F.lit("duplicado")} if confirm else {"duplicata_de": F.lit(None).cast("string")}
    return hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("_hit")


REVIEW = ["status_conferencia", "conferido_em", "revisado_em", "observacoes_conferencia"]


def preserve_review(fresh: DataFrame, registry: DataFrame, reset_review: bool = False) -> DataFrame:
    """ST-8, JOI-9: re-processed rows take over the review state they had."""
    names = [c for c in REVIEW if c in registry.columns]
    if reset_review or not names:
        return fresh
    old = registry.select("md5", *[F.col(c).alias(f"_{c}") for c in names])
    return fresh.join(old, "md5", "left").withColumns({c: F.coalesce(f"_{c}", c if c in fresh.columns else F.lit(None)) for c in names}).drop(*[f"_{c}" for c in names])


def unify_institutions(registry: DataFrame) -> DataFrame:
    """ST-9."""
    return registry.withColumn("faculdade", F.coalesce(X.normalize_institution("faculdade"), "faculdade"))


def approve(registry: DataFrame, md5: str, at: str) -> DataFrame:
    """ST-10: one row approved; learning its rule is SIG-14."""
    hit = F.col("md5") == md5.strip().lower()
    return registry.withColumns({"status_conferencia": F.when(hit, "aprovado").otherwise(F.col("status_conferencia")), **({"conferido_em": F.when(hit, at).otherwise(F.col("conferido_em"))} if "conferido_em" in registry.columns else {})})


def set_primary_type(registry: DataFrame, chosen: DataFrame, tipo: str) -> DataFrame:
    """ST-12: main class, and the domain it tells."""
    return retag(registry, chosen, tipo=None).join(chosen.select("md5").distinct().withColumn("_hit", F.lit(True)), "md5", "left").withColumns({"tipo_documento": F.when(F.col("_hit"), tipo).otherwise(F.col("tipo_documento")), "dominio": F.when(F.col("_hit"), C.type_to_domain(F.lit(tipo))).otherwise(F.col("dominio"))}).drop("_hit")


def remove_type(tipo: str) -> dict[str, Column]:
    """ST-13: columns of a row without a class: the next one (else 'Outro') leads; PIX values and a financial domain go with the last class of their kind."""
    left = F.filter("todos_tipos", lambda x: F.lower(x) != tipo.lower())
    main = F.when(F.lower("tipo_documento") == tipo.lower(), F.coalesce(F.get(left, F.lit(0)), F.lit("Outro"))).otherwise(F.col("tipo_documento"))
    pix = F.exists(F.array_append(left, main), lambda x: F.lower(x).contains("pix"))
    money = F.exists(F.array_append(left, main), lambda x: C.type_to_domain(x) == "financeiro")
    return {"valor_monetario": F.when(pix | (F.lit("pix" not in tipo.lower())), F.col("valor_monetario")), "dominio": F.when((F.col("dominio") == "financeiro") & ~money, C.type_to_domain(main)).otherwise(F.col("dominio")), "tipo_documento": main, "todos_tipos": left}


def remove_pix(registry: DataFrame) -> DataFrame:
    """ST-14: value and PIX keys cleared, PIX classes dropped, class and domain put right."""
    left = F.filter("todos_tipos", lambda x: ~F.lower(x).contains("pix"))
    main = F.when(F.lower("tipo_documento").contains("pix"), F.coalesce(F.get(left, F.lit(0)), F.lit("Outro"))).otherwise(F.col("tipo_documento"))
    bag = F.to_json(F.map_filter(F.from_json("dados_extras", "map<string,string>"), lambda k, v: ~k.startswith("pix_")))
    return registry.withColumns({"valor_monetario": F.lit(None).cast("string"), "dominio": C.type_to_domain(main), "dados_extras": bag, "tipo_documento": main, "todos_tipos": left})


def add_type(tipo: str) -> Column:
    """ST-15."""
    return F.when(F.exists("todos_tipos", lambda x: F.lower(x) == tipo.lower()), F.col("todos_tipos")).otherwise(distinct_folded(F.array_append("todos_tipos", F.lit(tipo))))


def not_known(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-3."""
    return rows.join(registry.select("md5"), "md5", "left_anti")


def restrict(registry: DataFrame, chosen: DataFrame) -> DataFrame:
    """JOI-4."""
    return registry.join(chosen.select("md5"), "md5", "left_semi")


def reconcile(consolidated: DataFrame, single: DataFrame) -> DataFrame:
    """SRC-4: the consolidated registry and the rows it lacks."""
    return consolidated.unionByName(not_known(single, consolidated), allowMissingColumns=True)


def placeholders(files: DataFrame, registry: DataFrame) -> DataFrame:
    """SRC-9, SET-1: rows for files that the registry does not know; payment receipts by name are financial."""
    name = X.fold("nome_arquivo")
    paid = X.any_of(name, ["pix", "comprovante", "recibo", "pagamento", "boleto"]) & ~X.any_of(name, ["inscricao", "residencia", "matricula", "cnpj", "rendimentos"])
    return not_known(files, registry).select("md5", "nome_arquivo", F.when(paid, "financeiro").otherwise("academico").alias("dominio"), F.lit("nao_processado").alias("status"), F.lit("pendente").alias("status_conferencia"))


def fill_file_attrs(registry: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-10."""
    names = [c for c in ("nome_arquivo", "caminho_relativo", "extensao") if c in files.columns and c in registry.columns]
    new = files.select("md5", *[F.col(c).alias(f"_{c}") for c in names])
    return registry.join(new, "md5", "left").withColumns({c: F.coalesce(X.nonblank(c), f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


def compare_pairs(pairs: DataFrame, registry: DataFrame, fields: list[str]) -> DataFrame:
    """JOI-8, DUP-9: every field of both sides as igual, difere or nao_comparavel."""
    side = lambda p: registry.select(F.col("md5").alias(f"{p}_md5"), F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(p))
    both = pairs.join(side("canonico"), "canonico_md5").join(side("duplicata"), "duplicata_md5")
    row = lambda c: F.struct(F.lit(c).alias("campo"), F.col(f"canonico.{c}").alias("a"), F.col(f"duplicata.{c}").alias("b"))
    verdict = F.when(X.blank("x.a") | X.blank("x.b"), "nao_comparavel").when(F.lower(F.trim("x.a")) == F.lower(F.trim("x.b")), "igual").otherwise("difere")
    return both.select("canonico_md5", "duplicata_md5", F.explode(F.array(*[row(c) for c in fields])).alias("x")).select("canonico_md5", "duplicata_md5", "x.campo", verdict.alias("resultado"))


def save_reviewed(registry: DataFrame, rules: DataFrame, changes: DataFrame, pages: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """ST-10: the registry with reviewed rows saved and approved, and the rules with those learned from their pages (md5, tipo, texto)."""
    from acervo.operators.classify import learn_rules

    saved = set_review(upsert(registry, changes), changes, "aprovado", at=at)
    learned = learn_rules(pages.join(changes.select("md5").distinct().hint("shuffle_hash"), "md5", "left_semi"))
    return saved, upsert_rules(rules, learned)


def reclassify(registry: DataFrame, pages: DataFrame, changes: DataFrame) -> DataFrame:
    """ST-11: registry rows after page changes (md5, pagina, tipo): main class, domain, classes and page list rebuilt.

    A document without pages first gets a list up to its last changed one: its main class on
    page 1, "Página n" on the others.  A change of page 1 also sets the main class.  Classes
    leave out "Página ..."; domains come from the classes.
    """
    # pages and changes of a document meet once, by its md5; everything else happens inside its row
    new = changes.select("md5", F.struct("pagina", "tipo").alias("_novo"))
    met = pages.select("md5", F.struct("pagina", "tipo").alias("_pagina")).unionByName(new, allowMissingColumns=True)
    # a document's pages are a bounded list, as in its own row
    listed = met.groupBy("md5").agg(F.collect_list("_pagina").alias("_proprias"), F.array_sort(F.collect_list("_novo")).alias("_novas")).filter(F.size("_novas") > 0)
    out = registry.join(listed.hint("shuffle_hash"), "md5", "left")

    def given(page: Column) -> Column:
        """The class a page is changed to, null if none."""
        return F.array_max(F.transform(F.filter("_novas", lambda c: c["pagina"] == page), lambda c: c["tipo"]))

    last = F.array_max(F.transform("_novas", lambda c: c["pagina"])).cast("int")
    first = F.transform(F.sequence(F.lit(1), last), lambda p: F.struct(p.cast(pages.schema["pagina"].dataType).alias("pagina"), F.when(p == 1, F.coalesce("tipo_documento", F.lit("Página 1"))).otherwise(F.concat(F.lit("Página "), p)).alias("tipo")))
    before = F.when(F.size("_proprias") > 0, F.col("_proprias")).otherwise(first)
    after = F.array_sort(F.transform(before, lambda p: F.struct(p["pagina"].alias("pagina"), F.coalesce(given(p["pagina"]), p["tipo"]).alias("tipo"))))
    out = out.withColumn("_paginas", after).withColumn("_lead", given(F.lit(1))).drop("_proprias", "_novas")
    kinds = F.array_distinct(F.filter(F.transform("_paginas", lambda p: p["tipo"]), lambda t: t.isNotNull() & ~t.startswith("Página ")))
    main = F.coalesce("_lead", "tipo_documento")
    out = out.withColumns({"tipo_documento": main, "dossie_paginas": F.col("_paginas"), "todos_tipos": F.when(F.col("_paginas").isNotNull(), kinds).otherwise(F.array())})
    domains = F.when(F.col("_paginas").isNotNull(), C.recalculated_domains("dominio", "todos_tipos"))
    return out.withColumn("todos_dominios", domains).drop("_paginas", "_lead")
