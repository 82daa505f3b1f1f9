"""From raw documents to packed training sequences: four stages over the ``documents`` table.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet to the shared
folder and read again as the next stage's input, so a lost executor costs one stage's tasks at most.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bestfit import pack_documents
from ledgerloom.llm.langid import keep_known_languages
from ledgerloom.llm.odd_sketch_dedup import drop_near_duplicates
from ledgerloom.llm.toxicity import drop_toxic
from ledgerloom.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; it learns from the stage's own input."""
    return keep_known_languages(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; the model learns from ``labels`` and the stage's own input."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("best_fit_packing", packing),
]

# Models and sketches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
