"""A corpus from raw documents to packed sequences, each stage one operator of ``tidewatch.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is
written before the next one reads it. All but the last return the columns of the
documents. Rows with a null id or text go through like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, language_id, line_templates, packing, simhash
from tidewatch.llm.base import documents, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# texts further from every learned language are in none of them; figures in the README
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts in none go, as do those that are null or have no letter."""
    return language_id.accepted(docs, language_id.learn_profiles(docs), LEAST_SCORE)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs stay in the first document only; emptied documents go."""
    return line_templates.without_recurring_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, null ids last."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequence and offset."""
    return packing.pack_documents(docs, added_tokens=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]

# fitted profiles, fingerprints and tokenizers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet before the next reads it."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
