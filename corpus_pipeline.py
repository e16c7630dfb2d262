"""A corpus pipeline: language, quality, near duplicates, benchmark texts, tokens.

Each stage takes what the one before has kept and gets it as a Parquet table, so a lost executor or a failed stage repeats only its own
work. All stages but the last return the columns of documents; the last returns tokens.

Defined results: null and letterless texts go in the first stage, so no later stage of a run sees them, though each accepts them. Repeated
rows are kept by the first two stages and reduced to one by the third. Extra columns stay until the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import decontamination, language, quality, sentencepiece, similar
from snapledger.llm.common import free_name, table
from snapledger.llm.training import language_model, quality_model
from snapledger.session import ensure_checkpoint_dir

# A text is rejected if no language has this probability over its positions. With three or fewer languages that cannot happen, with four
# hardly: in practice the stage rejects only undetermined texts.
LEAST_LANGUAGE = 0.3
LEAST_QUALITY = 0.7


def _only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language that is likely enough."""
    name = free_name(docs, "_language")
    found = language.identified(docs, language_model(spark, folder), out=name)
    known = (F.col(name)["lang"] != language.UNDETERMINED) & (F.col(name)["score"] >= LEAST_LANGUAGE)
    return _only(found.filter(known), docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents of low quality."""
    name = free_name(docs, "_quality")
    found = quality.scored(docs, quality_model(spark, folder), out=name)
    return _only(found.filter(F.col(name) >= LEAST_QUALITY), docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near duplicates: five-word shingles of similarity 0.8 or more.

    Candidates are fingerprints linked by pigeonring, as in ``op8_simhash``, and texts that share a key of smallest hashes.
    """
    return similar.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    name = free_name(docs, "_hits")
    found = decontamination.contaminated(docs, table(spark, folder, "benchmark"), out=name)
    return _only(found.filter(F.size(F.col(name)["spans"]) == 0), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ``ids`` holds little-endian unsigned 32-bit integers."""
    coded = sentencepiece.encoded(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "tokens.n_tokens", "tokens.ids", F.sha2("tokens.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language_stage), ("quality", quality_stage), ("near_duplicates", duplicates_stage), ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

# SQL cannot express the models and the encoder; tests run every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
