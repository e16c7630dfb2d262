"""Streaming admission of batches that arrive in pieces.

A collector delivers a batch as any number of files and one end mark that says how many records it sent. Records wait until their batch is
whole, whatever micro-batches they come in, and the batch is judged once. A batch that stays incomplete for ``patience`` of event time is
judged too, as one whose collector failed, so it is refused with its reason and its records are kept as evidence.

What waits is stored per micro-batch: the records of open batches and the clock, the newest event time seen. Judged batches leave with
the next write, so a micro-batch reads and writes no more than the open batches. A repeated micro-batch starts from the same stored rows
and replaces its own output; ``judge`` must skip batches it finished before, as the ingest plans do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from snapledger.plans.admission import Outcome, admit_prices, contract_records
from snapledger.streaming.jobs import run_batches

# Columns every delivered row has beside those of its record. An end mark has ``expected`` and no record.
ENVELOPE_DDL = "batch_id STRING, source_id STRING, started_at TIMESTAMP, external_run_id STRING, sent_at TIMESTAMP, expected BIGINT"
ENVELOPE = [part.split()[0] for part in ENVELOPE_DDL.split(", ")]


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """What the newest micro-batch before ``before`` left waiting."""
    try:
        known = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    newest = known.filter(F.col("micro") < before).agg(F.max("micro").alias("m")).first()["m"]
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/micro={newest}")


def batch_states(waiting: DataFrame, clock: DataFrame, patience: str) -> DataFrame:
    """One row per open batch: what came, what was announced, and whether it is whole or has waited too long."""
    marked = F.col("expected").isNotNull()
    seen = waiting.groupBy("batch_id").agg(
        F.min("source_id").alias("source_id"), F.min("started_at").alias("started_at"), F.min("external_run_id").alias("external_run_id"),
        F.count_if(~marked).alias("received"), F.max("expected").alias("expected"), F.max("sent_at").alias("last_sent"))
    limit = F.col("clock") - F.expr(f"interval {patience}")
    return seen.join(clock, F.lit(True)).select(
        *seen.columns, (F.col("received") >= F.col("expected")).alias("_whole"), (F.col("last_sent") < limit).alias("_late")
    ).withColumns({"whole": F.coalesce("_whole", F.lit(False)), "late": F.coalesce("_late", F.lit(False))}).drop("_whole", "_late")


def manifest_of(states: DataFrame) -> DataFrame:
    """The manifest of batches that are judged now; incomplete ones carry the reason as their collector's error."""
    shown = F.concat(F.lit("incomplete: "), F.col("received").cast("string"), F.lit(" of "), F.coalesce(F.col("expected").cast("string"), F.lit("unknown")), F.lit(" records"))
    return states.select("batch_id", "source_id", "started_at", "external_run_id", F.when(~F.col("whole"), shown).alias("collector_error"))


def land(rows: DataFrame, micro: int, root: str, judge: Callable[[DataFrame, DataFrame, int], object], patience: str) -> None:
    """One micro-batch: add its rows to what waits, judge the batches that are whole or late, keep the rest."""
    spark, schema = rows.sparkSession, rows.schema
    clocks = T.StructType([T.StructField("clock", T.TimestampType())])
    waiting = _stored(spark, f"{root}/waiting", schema, micro).unionByName(rows)
    told = _stored(spark, f"{root}/clock", clocks, micro).unionByName(rows.select(F.col("sent_at").alias("clock")))
    told.agg(F.max("clock").alias("clock")).write.mode("overwrite").parquet(f"{root}/clock/micro={micro}")
    clock = spark.read.schema(clocks).parquet(f"{root}/clock/micro={micro}")
    states = batch_states(waiting, clock, patience).checkpoint()
    due = states.filter("whole or late")
    if not due.isEmpty():
        judge(waiting.filter(F.col("expected").isNull()).join(due.select("batch_id"), "batch_id", "left_semi"), due, micro)
    open_ = waiting.join(due.select("batch_id"), "batch_id", "left_anti").select(*schema.names)
    open_.write.mode("overwrite").parquet(f"{root}/waiting/micro={micro}")


def landing_stream(stream: DataFrame, judge: Callable[[DataFrame, DataFrame, int], object], root: str, checkpoint: str,
                   patience: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Judge every batch of a stream once and whole. ``judge`` gets the records, a row per batch (see :func:`batch_states`), and the number."""
    return run_batches(stream, lambda rows, micro: land(rows, micro, root, judge, patience), checkpoint, available_now)


def price_landing(stream: DataFrame, root: str, checkpoint: str, default_url: str, patience: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Raw price records in envelopes into the ledger below ``root``: snapshots, changes, quarantine, incidents and run log."""

    def judge(records: DataFrame, due: DataFrame, micro: int) -> Outcome:
        raw = records.drop(*[c for c in ENVELOPE if c != "batch_id"])
        return admit_prices(contract_records(raw, default_url), manifest_of(due), f"{root}/ledger")

    return landing_stream(stream, judge, f"{root}/landing", checkpoint, patience, available_now)
