"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acervo.llm import ann, chat, decontam, html_text, licenses, lm, mixing, repeats, runs, secrets, simhash, toxicity, variants


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cross_polytope_ann(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op2_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_suffix_dedup(spark, sf_dir):
    return repeats.digest(repeats.strip(repeats.repeated_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))))


def op4_poisson_mix(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", "shuffle_key", "text")


def op5_html_main_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.digest(html_text.extract(pages, html_text.train(pages)))


def op6_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(_read(spark, sf_dir, "documents")))


def op8_gru_lm_score(spark, sf_dir):
    return lm.score(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark, sf_dir):
    return variants.group(variants.vocabulary(_read(spark, sf_dir, "documents").select("doc_id", "text"), change=variants.deleted))


def op12_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digest(chat.format_chats(turns))


def op13_word_runs(spark, sf_dir):
    return runs.digest(runs.find_runs(runs.with_periods(_read(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_polytope_ann, op2_license_scan, op3_suffix_dedup, op4_poisson_mix, op5_html_main_text, op6_secret_scan, op7_simhash_near_dedup, op8_gru_lm_score, op9_toxicity,
        op10_benchmark_decontamination, op11_spelling_variants, op12_chat_format, op13_word_runs,
    )
}
