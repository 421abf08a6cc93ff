"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpus_catalog.llm import (
    decontaminate, fill_middle, html_text, lattice_lm, licenses, near_dups, packing, periodic_runs, quality, sharding, substrings,
    token_counts, url_rules,
)
from corpus_catalog.llm.common import documents


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), threshold=0.85)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.train(pages))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of words to remove, with the document and word where the copy that stays begins."""
    found = substrings.repeated_paragraphs(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.col("first").alias("first_word"), F.col("size").alias("n_words"),
        F.col("first_id").alias("first_doc_id"), F.col("first_first").alias("first_doc_word"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, url_rules.default_rules())
    return url_rules.judge(documents(spark, sf_dir, "pages"), rules)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; in a tenth of them, the words from some place on are made periodic first."""
    return periodic_runs.digest(periodic_runs.periodic_runs(documents(spark, sf_dir), rearrange=periodic_runs.periodic_tail))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_main_text": op2_main_text,
    "op3_token_counts": op3_token_counts,
    "op4_repeated_paragraphs": op4_repeated_paragraphs,
    "op5_shards": op5_shards,
    "op6_lattice_scores": op6_lattice_scores,
    "op7_quality_rules": op7_quality_rules,
    "op8_leaks": op8_leaks,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_licenses": op10_licenses,
    "op11_url_verdicts": op11_url_verdicts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op8_leaks": decontaminate.LEAKS_SQL,
    "op11_url_verdicts": url_rules.sql(url_rules.default_rules()),
    "op13_fill_middle": fill_middle.SQL,
}
