"""Idempotent writes to the ledger: snapshots, changes, dimensions, quarantine, run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from snapledger.operators.ordered import last_before
from snapledger.schemas import ledger_schema

# Natural keys of the ledger tables.
NATURAL_KEYS = {
    "fact_price": ("run_id", "entity_id", "mode", "tier"),
    "fact_lifecycle": ("run_id", "api_id"),
    "fact_capability": ("run_id", "entity_id", "api_id"),
}
CHANGE_KEY = ("run_id", "entity_id", "change_type", "field_name", "mode", "tier")
ABANDONED = "Abandoned: a later collection run started for this source before this one reported an outcome."


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. A rank filter: tasks send one row per key, and each column once."""
    rest = [c for c in rows.columns if c not in keys]
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select(*keys, *rest)


def new_snapshots(rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, once each. Writing a run again therefore adds nothing."""
    return one_per_key(rows, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def read_ledger(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A ledger table under its declared schema, empty if nothing was written yet."""
    schema = ledger_schema(table)
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_incidents(spark: SparkSession, root: str, unfinished: DataFrame | None = None) -> DataFrame:
    """Incidents as they stand: the ledger keeps a row when one opens and another when it is resolved.

    ``unfinished``: batches (batch_id, source_id, started_at) that are judged once more after a lost job. What such a batch may have
    opened or resolved then does not count, since it is decided anew.
    """
    rows = read_ledger(spark, root, "fact_incident")
    if unfinished is not None:
        rows = rows.join(unfinished.select(F.col("batch_id").alias("run_id")), "run_id", "left_anti")
        ends = unfinished.select("source_id", F.col("started_at").alias("resolved_at"), F.lit("resolved").alias("status"))
        rows = rows.join(ends, ["source_id", "resolved_at", "status"], "left_anti")
    rest = [c for c in rows.columns if c != "incident_id"]
    newest = F.max_by(F.struct(*rest), F.when(F.col("status") == "resolved", 1).otherwise(0))
    return rows.groupBy("incident_id").agg(newest.alias("_r")).select("incident_id", "_r.*")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows under the declared columns and types of a ledger table; what they do not have is NULL."""
    fields = ledger_schema(table).fields
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def stored_near(rows: DataFrame, root: str, table: str, key: str, folder: str | None = None) -> DataFrame:
    """The stored rows that can share a key with ``rows``.

    The range of ``key`` and the values of ``folder`` are put into the scan as literals, so folders, files and row groups outside them
    are left out before anything is read. The driver holds two keys and the folders ``rows`` touches. ``rows`` is read for it, so it
    should be a checkpoint or a plain scan.
    """
    facts = [F.min(key).alias("low"), F.max(key).alias("high")]
    span = rows.agg(*facts, *([F.collect_set(folder).alias("folders")] if folder else [])).first()
    stored = read_ledger(rows.sparkSession, root, table)
    if span["low"] is None:
        return stored.filter(F.lit(False))
    near = stored.filter(F.col(key).between(F.lit(span["low"]), F.lit(span["high"])))
    return near.filter(F.col(folder).isin(span["folders"])) if folder else near


def append_snapshots(rows: DataFrame, root: str, table: str, order: Sequence[str] = ("observed_at", "snapshot_id")) -> None:
    """Append to a ledger table partitioned by month; only the months and runs the batch touches are read back."""
    dated = conform(rows.withColumn("month", F.date_format("observed_at", "yyyy-MM")), table)
    fresh = fresh_snapshots(rows, dated, stored_near(dated, root, table, "run_id", "month"), table, order)
    conform(fresh, table).write.mode("append").partitionBy("month").parquet(f"{root}/{table}")


def fresh_snapshots(rows: DataFrame, dated: DataFrame, stored: DataFrame, table: str, order: Sequence[str]) -> DataFrame:
    """What an append adds, dealt by month and then split by size, so a month gets as many writers as its rows need.

    Columns that ``rows`` do not have are added when everything is dealt, and the month, which their time gives, after the search by key.
    """
    known = [c for c in dated.columns if c != "month" and (c in rows.columns or c in NATURAL_KEYS[table])]
    fresh = new_snapshots(dated.select(*known), stored, NATURAL_KEYS[table], order)
    return fresh.withColumn("month", F.date_format("observed_at", "yyyy-MM")).hint("rebalance", F.col("month"))


def collapse_changes(changes: DataFrame, keys: Sequence[str] = CHANGE_KEY) -> DataFrame:
    """One row per event identity (NULL equals NULL). Identical repeats collapse, conflicting ones fail the job."""
    payload = [c for c in changes.columns if c not in keys]
    digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    grouped = changes.withColumn("_d", digest).groupBy(*keys).agg(
        F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.min_by(F.struct(*payload), "_d").alias("_r")
    )
    same = F.when(F.col("_low") == F.col("_high"), True).otherwise(
        F.raise_error(F.lit("conflicting change events share one identity")).cast("boolean")
    )
    return grouped.filter(same).select(*keys, "_r.*")


def append_changes(changes: DataFrame, root: str) -> None:
    """Append events that are not stored yet, partitioned by detection day."""
    dated = changes.withColumn("day", F.to_date("detected_at"))
    fresh = conform(collapse_changes(changes).withColumn("day", F.to_date("detected_at")), "fact_change")
    stored = stored_near(dated, root, "fact_change", "run_id", "day")
    match = None
    left, right = fresh.alias("n"), stored.select(*CHANGE_KEY).alias("s")
    for key in CHANGE_KEY:
        test = F.col(f"n.{key}").eqNullSafe(F.col(f"s.{key}"))
        match = test if match is None else match & test
    left.join(right, match, "left_anti").hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(f"{root}/fact_change")


def merge_dimension(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Upsert: the first sighting stays, the last sighting advances, attributes follow the newest sighting."""
    both = stored.unionByName(incoming)
    newest = F.struct("last_seen_at", *[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes])
    return both.groupBy(*keys).agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        *[F.max_by(a, newest).alias(a) for a in attributes],
    )


def read_dimension(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A dimension as it stands: the newest of its stored versions, empty if there is none."""
    schema = ledger_schema(table)
    try:
        stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])).parquet(f"{root}/{table}")
        newest = stored.agg(F.max("version")).first()[0]
    except AnalysisException:
        newest = None
    return spark.createDataFrame([], schema) if newest is None else stored.filter(F.col("version") == newest).drop("version")


def write_dimension(rows: DataFrame, root: str, table: str) -> None:
    """Write a dimension as a new version beside the old one, so readers of the old one are not disturbed."""
    spark = rows.sparkSession
    try:
        newest = spark.read.parquet(f"{root}/{table}").agg(F.max("version")).first()[0]
    except AnalysisException:
        newest = 0
    conform(rows, table).write.parquet(f"{root}/{table}/version={newest + 1}")


def append_new(rows: DataFrame, root: str, table: str, keys: Sequence[str]) -> None:
    """Append the rows whose key is not stored yet; stored rows are read in the range of the first key only."""
    shaped = conform(rows, table)
    stored = stored_near(shaped, root, table, keys[0])
    shaped.join(stored.select(*keys), list(keys), "left_anti").write.mode("append").parquet(f"{root}/{table}")


def upsert_named(rows: DataFrame, root: str, table: str, keys: Sequence[str]) -> None:
    """A new version of a dimension: given rows replace the stored ones of their key, and what they leave NULL stays as it was.

    Of several given rows of a key the first in the order of their columns counts.
    """
    stored, given = read_dimension(rows.sparkSession, root, table), conform(rows, table)
    rest = [c for c in given.columns if c not in keys]
    one = one_per_key(given, keys, rest)
    both = stored.join(one.withColumnsRenamed({c: f"_{c}" for c in rest}), list(keys), "full_outer")
    write_dimension(both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in rest]), root, table)


def register_sources(sources: DataFrame, root: str) -> None:
    """Providers and sources, as an ingest announces them.

    ``sources``: source_id and provider_id, and what is known of kind, collector_id, source_url, label and is_active, and of the
    provider's slug, name and homepage_url. New sources are active unless they say otherwise. Where sources describe their provider
    differently the smallest text counts.
    """
    known = read_dimension(sources.sparkSession, root, "dim_source").select("source_id", F.lit(True).alias("_known"))
    given = conform(sources, "dim_source").join(known, "source_id", "left")
    active = F.when(F.col("_known").isNull(), F.coalesce("is_active", F.lit(True))).otherwise(F.col("is_active"))
    shown = conform(sources, "dim_provider")
    providers = shown.groupBy("provider_id").agg(*[F.min(c).alias(c) for c in shown.columns if c != "provider_id"])
    upsert_named(providers, root, "dim_provider", ["provider_id"])
    upsert_named(given.withColumn("is_active", active), root, "dim_source", ["source_id"])


def run_log(records: DataFrame, accepted: Column, run: str = "run_id") -> DataFrame:
    """Counts and final status per run: partial as soon as one record was rejected."""
    counted = records.groupBy(run).agg(
        F.count(F.lit(1)).alias("records_seen"), F.count_if(accepted).alias("records_accepted")
    )
    rejected = F.col("records_seen") - F.col("records_accepted")
    return counted.withColumn("records_rejected", rejected).withColumn(
        "status", F.when(rejected > 0, "partial").otherwise("succeeded")
    )


def skip_replayed(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Runs that are not a repeat of an external run already finished for the same source."""
    done = log.filter(F.col("status").isin("succeeded", "partial") & F.col("external_run_id").isNotNull())
    return incoming.join(done.select("source_id", "external_run_id"), ["source_id", "external_run_id"], "left_anti")


def close_abandoned(runs: DataFrame, segment: Column) -> DataFrame:
    """Runs still ``running`` when a later run of their source started become failed at that start."""
    paired = last_before(runs, ["source_id"], ["started_at", "run_id"], segment, F.col("started_at"), "_next", reverse=True)
    abandoned = (F.col("status") == "running") & F.col("_next").isNotNull()
    return paired.withColumns({
        "completed_at": F.when(abandoned, F.col("_next")).otherwise(F.col("completed_at")),
        "error_message": F.when(abandoned, ABANDONED).otherwise(F.col("error_message")),
        "status": F.when(abandoned, "failed").otherwise(F.col("status")),
    }).drop("_next")
