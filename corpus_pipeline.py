"""Training-data pipeline over ``documents``: rules, classifier, near-duplicates, repeated bytes, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's documents. All stages but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import classifier, column_dedup, packing, quality_rules, superminhash
from strata.session import persist_table
from strata.sources.tables import table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and are no outliers of their language and source."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good by the classifier; labels of rejected documents are still learned
    from where the documents are among those the stage gets."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return superminhash.keep_first(docs)


def repeated_bytes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the byte strings that also start earlier."""
    return column_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), name="pipeline-packing")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_dedup", repeated_bytes_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the robust estimates nor the trained classifier nor the byte cuts; tests
#: hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, starting from the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
