"""Registry of the operators' queries: name -> (spark, sf_dir) -> DataFrame,
and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op01_repeats, op02_decontaminate, op03_url_rules, op04_wrappers, op05_bpe_trie, op06_rp_forest,
    op07_token_counts, op08_lang_cnn, op09_chosen_path, op10_line_dedup, op11_warc, op12_prefix_trie,
    op13_spelling, sql,
)
from .stage import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_decontaminate.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return op03_url_rules.judge_urls(pages, op03_url_rules.rules_table(spark))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_wrappers.extract_text(table(spark, sf_dir, "pages"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_bpe_trie.bpe_digest(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op06_rp_forest.nearest(vectors, F.col("id") % 100 == 0, "vec_id", "embedding")


def op7_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_lang_cnn.predict_languages(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_chosen_path.near_duplicate_digest(table(spark, sf_dir, "documents"))


def op10_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_warc.warc_digest(table(spark, sf_dir, "pages"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie.trie_digest(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling.spelling_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    "op1_repeated_text": op1_repeated_text,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_html_text": op4_html_text,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_nearest": op6_nearest,
    "op7_token_counts": op7_token_counts_query,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup_query,
    "op11_warc_archives": op11_warc_archives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": sql.DECONTAMINATION,
    "op3_url_filters": sql.URL_FILTERS,
    "op10_line_dedup": sql.LINE_DEDUP,
    "op11_warc_archives": sql.WARC_ARCHIVES,
    "op12_conversation_trie": sql.PREFIX_TRIE,
}
