"""From raw documents to packed sequences: five stages, each written before the next one reads it.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, or
for the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweft.llm import hyperminhash, packing, perplexity, pivotal, secret_scan
from cellweft.llm.common import table, written
from cellweft.llm.queries import TOKENIZER_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or lie outside their language's perplexity band go."""
    return perplexity.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return hyperminhash.one_per_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that few owners hold are masked in the text; widely copied examples stay."""
    return secret_scan.mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return pivotal.repeat_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2,048 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER_FILE))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer, language model or rounding tree; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
