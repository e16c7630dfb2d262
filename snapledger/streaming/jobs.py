"""Streaming jobs over files: replay dedupe, daily counts, staleness. See ``landing`` for admission and ``changes`` for live changes.

Every job can run with ``available_now`` and then stops after the files present, or keep running. Jobs
with their own outputs write them per micro-batch id, so a repeated micro-batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from snapledger.functions.values import age_minutes
from snapledger.operators.health import freshness
from snapledger.operators.ordered import latest


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int | None = None,
               names: str = "*") -> DataFrame:
    """Files of a folder as a stream; ``names`` narrows them by file name."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
                mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step)
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def first_delivery(runs: DataFrame, delay: str = "40 days") -> DataFrame:
    """One row per external run that ended well, while its repeats can still arrive within ``delay``; older state is dropped.

    A run that failed, or has no external id, repeats nothing and blocks nothing: it passes, and so does its retry.
    """
    ended_well = F.col("status").isin("succeeded", "partial") & F.col("external_run_id").isNotNull()
    delivery = F.when(ended_well, F.concat(F.lit("external/"), "external_run_id")).otherwise(F.concat(F.lit("run/"), F.col("run_id").cast("string")))
    keyed = runs.withColumn("_delivery", delivery).withWatermark("started_at", delay)
    return keyed.dropDuplicatesWithinWatermark(["source_id", "_delivery"]).drop("_delivery")


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per UTC day, provider and category.

    In update mode (see :func:`write_updates`) rows of days that the watermark has passed are dropped, and their state is freed.
    """
    return (
        events.withWatermark("detected_at", delay)
        .groupBy(F.window("detected_at", "1 day").alias("w"), "provider", "category")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.to_date("w.start").alias("day"), "provider", "category", "events")
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the groups that each micro-batch changed. :func:`newest_rows` reads the result."""
    def step(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(stream, step, checkpoint, available_now, "update")


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of every group."""
    return latest(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def last_starts(runs: DataFrame) -> DataFrame:
    """Newest start and newest success per source; the state is one row per source."""
    return runs.groupBy("source_id").agg(
        F.max("started_at").alias("last_start"),
        F.max(F.when(F.col("status") == "succeeded", F.col("started_at"))).alias("last_success"),
    )


def silent_sources(starts: DataFrame, now: Column, cadence_minutes: Column, max_staleness_minutes: Column) -> DataFrame:
    """Freshness of every source and whether it missed its cadence."""
    age = age_minutes(F.col("last_success"), now)
    return starts.withColumns({
        "age_minutes": age,
        "freshness": freshness(age, max_staleness_minutes),
        "overdue": age_minutes(F.col("last_start"), now) > cadence_minutes,
    })


def starts_stream(runs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest start and success of every source up to date; a micro-batch writes the sources it touched."""
    return write_updates(last_starts(runs), path, checkpoint, available_now)


def silent_now(spark: SparkSession, path: str, now: Column, cadence_minutes: Column, max_staleness_minutes: Column) -> DataFrame:
    """All sources of a :func:`starts_stream` judged at ``now``.

    A batch to run on a timer: it needs no new rows, so a feed that has fallen silent altogether is reported too.
    """
    return silent_sources(newest_rows(spark, path, ["source_id"]), now, cadence_minutes, max_staleness_minutes)
