"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table; each is written and read again before the next one.
Quality rules and language identification drop the documents that they reject, near-deduplication keeps
one document of each group, substring deduplication takes repeated passages out of the texts, and
packing cuts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import langid, near_dedup, packing, quality, substring_dedup
from lacuna.llm._spark import materialize, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.filter_documents(docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.filter_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", _quality),
    ("language", _language),
    ("near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("packing", _packing),
]

#: Hash functions, sketches and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
