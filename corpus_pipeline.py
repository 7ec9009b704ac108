"""Corpus pipeline: raw documents to token files.

Quality rules drop documents, one document of each near-duplicate group stays, documents that hold a benchmark item go,
sources are mixed to their target weights, and what is left is written as token ids and read back. Every stage takes
all rows its predecessor kept; all but the last return the columns of ``documents``.

Result cases. Null text: no words, so the quality rules drop it. Null or repeated ids: rows are decided one by one, and a row that
stays keeps its id. Rows equal in everything: one stays. Ties: smallest id, then smallest hash of the row. Very long
texts: whole in every stage. Empty table: no rows. Extra columns, whatever their names, are carried to the last stage, which
returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelake.llm import decontaminate, mixing, quality, simhash, tokenfiles
from pricelake.llm.common import run_folder, table
from pricelake.session import ship_code

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_code(spark)
    return tokenfiles.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_to_weights),
    ("token files", token_files),
]

# a tokenizer is not SQL; tests/llm/test_pipeline.py holds the rows against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
