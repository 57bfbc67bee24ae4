"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. Near duplicates are word shingles of five at a similarity of 0.8.
The stages in SQL: language ID cannot be expressed there, so there is none for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import table, written
from tallyspark.llm.decontaminate import without_contaminated
from tallyspark.llm.exact_dedup import without_copies
from tallyspark.llm.language_id import in_known_languages
from tallyspark.llm.mixing import mix
from tallyspark.llm.ngram_join import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the learnt languages, and texts without a letter, go."""
    return in_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when: all columns of the mixing query."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
