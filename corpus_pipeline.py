"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  What a stage returns is written
and read again before the next one, so a lost executor costs one stage.

1. language ID: texts without a letter, or of no language known, go;
2. line dedup: lines that five or more documents share stay in one of them;
3. n-gram Jaccard join: one document of each near-duplicate group stays;
4. decontamination: documents with a benchmark passage go;
5. BPE: the texts as token ids, with the decoded text's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import op02_decontaminate, op05_bpe_trie, op08_lang_cnn, op09_chosen_path, op10_line_dedup
from catchment.llm.stage import table, written


#: Bytes of encoded chunks a worker remembers here: workers of the stages
#: before still live beside it.
CHUNK_BYTES = 96 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_lang_cnn.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its dropped lines (a null text stays null)."""
    kept = op10_line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("__ld_kept"))
    return kept.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_chosen_path.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = op02_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter("__dc_hit = 0").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = op05_bpe_trie.encode_texts(docs, hashed=True, max_bytes=CHUNK_BYTES)
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        "decoded_sha256",
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the network, the join at its recall, or the encoder;
#: ``tests/llm/test_pipeline.py`` compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
