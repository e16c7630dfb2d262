"""Stored current state: the newest row of every identity, kept beside the ledger, so that a read does not rank the history.

An ingest appends the newest row per identity of what it admits as a delta; a read merges the deltas into the last base; ``compact``
writes the next base from both. Rows are kept in folders by a hash of the entity, so a read of some entities opens their folders only
and an ingest writes to those of its own entities.

Merging takes the newest row, so a row that is there twice changes nothing. Crashes and jobs that run side by side rest on that:

* A base counts once its number stands in the list of commits, which is written last. A half-written base is overwritten.
* Deltas name the base they were written after. A read takes those of the last base and of the one before, so a delta that is written
  while a base is made is not lost. Only a delta that is under way during two compactions would be.
* Rows of a run that is not logged yet do not count. A base carries them along, for the repeated job may still log it.

Before the first compaction the history itself is the base, so ledgers without a stored state read right and are ranked once. Old bases
stay where they are, for readers that have begun with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from snapledger.operators.current import COMPARABLE_STATUSES
from snapledger.operators.ordered import latest
from snapledger.schemas import LEDGER_DDL
from snapledger.sources import sinks

# What names one state, and which of its rows is the newest.
IDENTITY = {
    "fact_price": ("source_id", "entity_id", "mode", "tier"),
    "fact_lifecycle": ("source_id", "entity_id", "api_id"),
    "fact_capability": ("source_id", "entity_id", "api_id"),
}
ORDER = ("observed_at", "created_at", "snapshot_id")
# Fixed for a ledger: rows are found by it. A folder holds as many files as its rows need.
BUCKETS = 32
# Parts of a folder that one write deals its rows to, at most.
SPREAD = 32


def bucket(entity: Column) -> Column:
    """The folder of an entity. Constant for a constant, so a filter on it prunes folders."""
    return F.pmod(F.xxhash64(F.coalesce(entity, F.lit(""))), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _place(root: str, table: str) -> str:
    return f"{root}/current/{table}"


def version(spark: SparkSession, root: str, table: str) -> int:
    """Number of the last base, 0 before the first."""
    return _read(spark, f"{_place(root, table)}/commits", "version INT").agg(F.max("version")).first()[0] or 0


def _rows(spark: SparkSession, root: str, table: str, entity_ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(rows known to count, rows that count if their run is logged, number of the base)."""
    place, number, ddl = _place(root, table), version(spark, root, table), LEDGER_DDL[table]
    columns = T.StructType.fromDDL(ddl).fieldNames()

    def near(rows: DataFrame) -> DataFrame:
        if entity_ids is None:
            return rows.select(*columns)
        wanted = F.col("entity_id").isin(list(entity_ids))
        if "bucket" in rows.columns:
            wanted &= F.col("bucket").isin([bucket(F.lit(e)) for e in entity_ids])
        return rows.filter(wanted).select(*columns)

    if number == 0:
        history = near(sinks.read_ledger(spark, root, table))
        return history.filter(F.lit(False)), history, 0
    base = _read(spark, f"{place}/base", f"{ddl}, pending BOOLEAN, version INT, bucket INT").filter(F.col("version") == number)
    delta = _read(spark, f"{place}/delta", f"{ddl}, after INT, bucket INT").filter(F.col("after") >= number - 1)
    return near(base.filter(~F.col("pending"))), near(delta).unionByName(near(base.filter("pending"))), number


def _logged(rows: DataFrame, root: str) -> DataFrame:
    """Runs of ``rows`` whose rows count; the log is read in the range of these runs."""
    runs = sinks.stored_near(rows.select("run_id"), root, "fact_run", "run_id")
    return runs.filter(F.col("status").isin(*COMPARABLE_STATUSES)).select("run_id")


def read_current(spark: SparkSession, root: str, table: str, entity_ids: Sequence[str] | None = None) -> DataFrame:
    """The newest row per identity of the table among finished runs, of all entities or of those given."""
    settled, open_, _ = _rows(spark, root, table, entity_ids)
    counted = open_.join(_logged(open_, root), "run_id", "left_semi")
    return latest(settled.unionByName(counted), IDENTITY[table], ORDER)


def _dealt(rows: DataFrame) -> DataFrame:
    # Dealt by folder and then split by size, so a folder gets as many writers as its rows need.
    return rows.withColumn("bucket", bucket(F.col("entity_id"))).hint("rebalance", F.col("bucket"))


def remember(rows: DataFrame, root: str, table: str) -> None:
    """Append admitted snapshot rows to the state, the newest per run and identity. To be done before their run is logged."""
    number = version(rows.sparkSession, root, table)
    keys = ["run_id", *IDENTITY[table]]
    # Dealt once, by folder and part: the window finds its rows together and a folder gets a few files. A run holds an identity once or
    # a few times, so nothing is gained by a choice before the rows are dealt.
    dealt = sinks.conform(rows, table).drop("month").withColumns({
        "bucket": bucket(F.col("entity_id")), "_part": F.pmod(F.xxhash64(*keys), F.lit(SPREAD))})
    kept = latest(dealt.repartition("bucket", "_part"), ["bucket", "_part", *keys], ORDER).drop("_part")
    stamped = kept.withColumn("after", F.lit(number))
    stamped.write.mode("append").partitionBy("after", "bucket").parquet(f"{_place(root, table)}/delta")


def compact(spark: SparkSession, root: str, table: str) -> int:
    """Write the next base from the last one and its deltas; returns its number. Work is that of the state, not of the history."""
    settled, open_, number = _rows(spark, root, table)
    # One pass over the rows and one reading of the log, so a run that is logged meanwhile is either counted or waiting as a whole.
    logged = _logged(open_, root).distinct().withColumn("_logged", F.lit(True))
    marked = open_.join(logged, "run_id", "left").withColumn("pending", F.col("_logged").isNull()).drop("_logged")
    # Of what waits the newest is kept per run, for any of these runs may still be logged.
    every = settled.withColumn("pending", F.lit(False)).unionByName(marked).withColumn("_run", F.when(F.col("pending"), F.col("run_id")))
    both = latest(every, [*IDENTITY[table], "pending", "_run"], ORDER).drop("_run")
    place, following = _place(root, table), number + 1
    _dealt(both).write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/base/version={following}")
    spark.createDataFrame([(following,)], "version INT").coalesce(1).write.mode("append").parquet(f"{place}/commits")
    return following
