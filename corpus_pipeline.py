"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

quality drops documents that the classifier rejects; exact keeps one of each
set of equal texts; near keeps the least doc_id of each group of similar texts;
benchmark cuts benchmark passages out of the texts; mix selects documents by
source to equal token budgets, weighed by the classifier's probability, and adds the
column copies (_copies where documents have one of that name).  Nulls, very long texts,
ties, repeated rows, empty tables and clashing columns are treated as the operators'
docstrings tell; a stage's ids are compared as numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from routeloom.llm.tables import delete, fresh, scratch, shared, stored, table, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weight = fresh(docs, "weight")
    rated = stored(quality.rated(docs, weight, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "rated")
    return mixing.mixed(rated, weight=F.col(weight)).drop(weight)


STAGES = [("quality", drop_low_quality), ("exact", drop_exact_copies), ("near", drop_near_copies), ("benchmark", cut_benchmark), ("mix", mix_sources)]

#: The first stage is a trained network, which SQL can't express; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared(spark, f"pipeline-{name}")
        with scratch(spark):
            written(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
