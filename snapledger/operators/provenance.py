"""Where a value came from and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import text
from snapledger.operators.gate import OPEN_STATES


def inadmissible(raw: Column, parameter: str = "hl") -> Column:
    """Capability evidence read from a translated page."""
    url = F.get_json_object(raw, "$.source_url")
    return text.query_parameter(url, parameter).isNotNull()


def trusted_events(events: DataFrame, snapshots: DataFrame, bad: Column, snapshot: str = "snapshot_id") -> DataFrame:
    """Events without those whose snapshot would be refused today. An event without a snapshot stays."""
    refused = snapshots.filter(bad).select(F.col("snapshot_id").alias(snapshot))
    return events.join(refused, snapshot, "left_anti")


def validation_state(run_id: Column, run_status: Column, has_open_incident: Column) -> Column:
    return (
        F.when(run_id.isNull(), "unknown").when(has_open_incident, "quarantined").when(run_status == "succeeded", "validated")
        .when(run_status.isin("partial", "failed"), "provisional").otherwise("unknown")
    )


def provenance(references: DataFrame, runs: DataFrame, sources: DataFrame, providers: DataFrame, incidents: DataFrame) -> DataFrame:
    """References (kind, ref_id, run_id, observed_at) with run, source, provider and trust.

    The open incidents are reduced to one row per run before they join, so no reference is repeated.
    """
    held = incidents.filter(F.col("status").isin(*OPEN_STATES)).select("run_id").distinct().withColumn("_held", F.lit(True))
    chain = (
        references.join(runs.select("run_id", "source_id", F.col("status").alias("run_status"), "external_run_id"), "run_id", "left")
        .join(sources.select("source_id", "provider_id", "kind", "source_url"), "source_id", "left")
        .join(providers, "provider_id", "left")
        .join(held, "run_id", "left")
    )
    state = validation_state(F.col("run_id"), F.col("run_status"), F.coalesce("_held", F.lit(False)))
    return chain.withColumns({"validation": state, "source_url": text.safe_url(F.col("source_url"))}).drop("_held")


def distinct_provenance(rows: DataFrame) -> DataFrame:
    """One row per (snapshot, url, time)."""
    return rows.select("snapshot_id", "source_url", "observed_at").distinct()
