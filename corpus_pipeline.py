"""A corpus pipeline of five of the operators in passagework.llm, each stage a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.bpe import tokenizer_file
from passagework.llm.exact_dedup import drop_copies
from passagework.llm.near_dedup import drop_near_copies
from passagework.llm.packing import digest, pack, refilled
from passagework.llm.rules import keep_good
from passagework.llm.secrets import mask_secrets
from passagework.llm.shared import settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a learned rule go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of their five-word shingles the smallest doc_id stays."""
    return drop_near_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked in its text."""
    return mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in the training sequences."""
    return refilled(settled(digest(pack(docs, tokenizer_file("byte_bpe_50k.json")))))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The learned rules and the tokens can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
