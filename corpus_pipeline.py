"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, PII removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of documents. The driver of a long run writes each stage's result as Parquet
and reads it back for the next, so a lost executor costs one stage at most.

No ORACLE_SQL: signatures, learned models and packing are beyond SQL; tests/llm compares each stage with
brute force. An empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bagminhash, decontam, langid, packing, pii
from tidemark.llm.common import load, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from docs itself. Texts without a letter go, null ones too; repeated rows each stay or go alike."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each class of near duplicates; of rows that repeat it one. Of the rows without doc_id one of each class stays beside it."""
    return bagminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items cover; those that are little else go. Null texts and an empty benchmark change nothing."""
    return decontam.remove_spans(docs, load(spark, sf_dir, "benchmark"))


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; where kinds overlap, by that of the first. Null texts stay null."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their sequence and place in it; a null text has its end id alone, pieces of equal length are placed in any order."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_removal", pii_removal),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
