"""Ingest: raw lifecycle batches through the gate into the ledger and onto the entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import text, values
from snapledger.operators import contracts, current, diff
from snapledger.plans.admission import Outcome, field_changes, gate_batches
from snapledger.sources import sinks

STATE = ["source_id", "entity_id", "api_id"]
FOLDED = ["lifecycle_state", "deprecated_on", "retirement_date", "retirement_not_before_date", "lifecycle_observed_at", "is_active"]


def deprecation_columns() -> dict[str, Column]:
    """What a deprecation table says: a state per API name, and a retirement date or its lower bound."""
    exact, bound = values.retirement_dates(F.col("tentative_retirement_date"))
    return {
        "api_id": F.col("api_model_name"), "state": F.lower("current_state"), "deprecated_on": values.english_date(F.col("deprecated_date")),
        "retirement_date": exact, "not_before_date": bound,
        "not_before_observation": F.when(bound.isNotNull(), "date").otherwise("unobserved"),
        "replacement": F.lit(None).cast("string"), "replacement_observed": F.lit(False), "source_url": F.col("product_page_url"),
    }


def shutdown_columns() -> dict[str, Column]:
    """What a shutdown table says: only the shutdown flag retires; an earliest date is a lower bound, never an exact one."""
    shown = F.col("shutdown_not_before_date_raw")
    return {
        "api_id": F.col("model_id"), "state": values.shutdown_state(F.col("is_shutdown"), shown), "deprecated_on": F.lit(None).cast("date"),
        "retirement_date": F.lit(None).cast("date"), "not_before_date": values.english_date(shown),
        "not_before_observation": values.shutdown_observation(shown), "replacement": text.trim_to_null(F.col("recommended_replacement")),
        "replacement_observed": F.col("recommended_replacement").isNotNull(), "source_url": F.col("product_page_url"),
    }


def snapshot_rows(valid: DataFrame, known: DataFrame, provider: str, columns: dict[str, Column]) -> DataFrame:
    rows = valid.join(known.select("batch_id", "source_id", F.col("started_at").alias("observed_at")), "batch_id")
    named = rows.select("batch_id", "source_id", "observed_at", *[c.alias(n) for n, c in columns.items()])
    digest = values.lifecycle_hash(*[F.col(c) for c in (
        "state", "deprecated_on", "retirement_date", "not_before_date", "not_before_observation", "replacement_observed", "replacement")])
    return named.select(
        F.concat_ws("/", "batch_id", "api_id").alias("snapshot_id"), F.col("batch_id").alias("run_id"), "source_id", F.lit(provider).alias("provider_id"),
        text.canonical_key(F.lit(provider), F.col("api_id"), F.col("api_id")).alias("entity_id"), *columns, F.lit(None).cast("string").alias("raw"),
        digest.alias("content_hash"), "observed_at", F.col("observed_at").alias("created_at"),
    )


def admit_lifecycle(records: DataFrame, manifest: DataFrame, root: str, provider: str, kind: str = "shutdown") -> Outcome:
    """Run announced lifecycle batches through the gate and write snapshots, field changes and the entities' lifecycle.

    ``kind`` is ``shutdown`` or ``deprecation``. A row or field that a page does not show changes nothing: every record is compared
    with the newest one of its API id, and only in the fields it speaks about.
    """
    contract, columns = {
        "shutdown": (contracts.shutdown_contract(), shutdown_columns()), "deprecation": (contracts.deprecation_contract(), deprecation_columns()),
    }[kind]
    gated = gate_batches(records, manifest, root, contract)
    snapshots = snapshot_rows(gated.valid, gated.known, provider, columns).checkpoint()
    before, after = gated.states(root, "fact_lifecycle", snapshots, "state", STATE)
    events = diff.diff_lifecycle(before, after, ["batch_id", *STATE])
    changes = field_changes(events, gated.decided, "lifecycle", "lifecycle_changed")
    return gated.write(root, "fact_lifecycle", snapshots, changes, lambda: _patch_entities(snapshots, root))


def _patch_entities(snapshots: DataFrame, root: str) -> None:
    """Fold all stored observations of the touched entities onto them; entities seen for the first time are added."""
    spark = snapshots.sparkSession
    stored = sinks.read_dimension(spark, root, "dim_entity")
    touched = snapshots.select("entity_id").distinct()
    history = sinks.read_ledger(spark, root, "fact_lifecycle").join(touched, "entity_id", "left_semi")
    folded = current.fold_lifecycle(history, ["entity_id"], ["observed_at", "snapshot_id"])
    seen = history.groupBy("entity_id").agg(
        F.min("provider_id").alias("_provider"), F.min("api_id").alias("_name"), F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last"))
    new = folded.join(seen, "entity_id").withColumnsRenamed({c: f"_{c}" for c in FOLDED})
    joined = stored.join(new, "entity_id", "full_outer")
    hit = F.col("_provider").isNotNull()
    patched = joined.withColumns({
        **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in FOLDED},
        "provider_id": F.coalesce("provider_id", "_provider"), "name": F.coalesce("name", "_name"),
        "first_seen_at": F.least("first_seen_at", "_first"), "last_seen_at": F.greatest("last_seen_at", "_last"),
    })
    sinks.write_dimension(patched, root, "dim_entity")
