"""The corpus pipeline: quality classifier, quality rules, Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases, for every stage: a null text is an empty one, which the classifier may keep and the rules reject; rows that share an id are rows of their own, and
of equal or nearly equal texts one row stays, whatever their ids; ties of a group go to the least id; texts are read whole at any length; an empty table
gives no rows; further columns pass through to the packing stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import decontaminate, jaccard_join, packing, quality_classifier, quality_rules
from veilmark.llm.common import read_table, written


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that the rules reject."""
    kept = quality_rules.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences."""
    return packing.packed_rows(docs, memo=75_000)  # executors have run the other stages by now: less memory for words


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", jaccard_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizers and the fitted classifier cannot be said in SQL; ``tests/llm`` holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
