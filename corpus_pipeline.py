"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetroll.llm.common import packed, table, unpacked, written
from fleetroll.llm.lines import dedup_lines
from fleetroll.llm.minhash import drop_near_duplicates
from fleetroll.llm.packing import pack_documents
from fleetroll.llm.quality import quality_filter
from fleetroll.llm.substrings import dedup_substrings


def _with_text(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the text that an operator gives, and its length where the table keeps one; other columns, whatever their names, stay."""
    out = unpacked(operator(packed(docs)).withColumn("text", text), docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them."""
    return _with_text(dedup_lines, docs, F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them; untouched texts keep their white space."""
    return _with_text(lambda d: dedup_substrings(d, window=50), docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]

#: Packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
