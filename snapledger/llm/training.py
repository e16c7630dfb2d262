"""Which rows of the tables the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import language, quality
from snapledger.llm.common import fold, table


def labelled(spark: SparkSession, folder: str, parts: int, held_out: int, label: str) -> DataFrame:
    """Documents with a label, outside the fold that is held out."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("_of"), F.col(label))
    labels = labels.filter(fold(F.col("_of"), parts) != held_out)
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return docs.join(labels, F.col("doc_id") == F.col("_of")).drop("_of")


def language_model(spark: SparkSession, folder: str) -> language.Model:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))


def quality_model(spark: SparkSession, folder: str) -> quality.Machine:
    return quality.fit(labelled(spark, folder, 4, 2, "quality"))
