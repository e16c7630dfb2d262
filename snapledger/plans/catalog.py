"""Ingest: raw catalog batches through the gate, onto entities, into the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions import text, values
from snapledger.operators import contracts, diff, identity
from snapledger.plans.admission import Outcome, field_changes, gate_batches
from snapledger.sources import sinks

STATE = ["source_id", "entity_id", "api_id"]


@dataclass(frozen=True)
class CatalogOutcome:
    outcome: Outcome
    # Records whose id several records claim with different evidence, and ids that may be more than one entity.
    conflicts: DataFrame
    unresolved: DataFrame


def one_per_id(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicting) records of each batch: enumerated ids expanded, then at most one record per id."""
    listed = identity.expand_enumerated(valid, "model_id").withColumn("_key", F.concat_ws("/", "batch_id", "model_id"))
    facts = [c for c in listed.columns if c not in ("batch_id", "position", "source_url", "_key", "issues", "schema_ok", "enum_fault")]
    fingerprint = F.md5(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}))
    slug = F.concat_ws("/", "batch_id", text.last_path_segment(F.col("source_url")))
    judged = identity.resolve_duplicates(listed, fingerprint, slug, "_key").drop("_key")
    return judged.filter("outcome = 'accepted'").drop("outcome"), judged.filter("outcome = 'conflict'")


def snapshot_rows(accepted: DataFrame, plan: DataFrame, known: DataFrame, provider: str) -> DataFrame:
    runs = known.select("batch_id", "source_id", F.col("started_at").alias("observed_at"))
    rows = accepted.join(runs, "batch_id").join(plan.select("api_id", "entity_id"), F.col("model_id") == F.col("api_id"))
    who = F.lit(provider)
    shaped = rows.select(
        F.concat_ws("/", "batch_id", "api_id").alias("snapshot_id"), F.col("batch_id").alias("run_id"), "source_id", who.alias("provider_id"), "entity_id", "api_id",
        text.trim_to_null(F.col("display_name")).alias("display_name"), values.family_of(who, F.col("api_id"), F.col("model_group")).alias("family"),
        values.stage_of(who, F.col("api_id")).alias("stage"), values.token_count(F.col("context_window_raw")).cast("bigint").alias("context_window"),
        values.token_count(F.col("max_output_tokens_raw")).cast("bigint").alias("max_output_tokens"),
        values.observed_flag(F.col("supports_vision"), values.any_matches(F.col("supported_features"), "(?i)vision")).alias("supports_vision"),
        values.observed_flag(F.col("supports_function_calling"), values.any_matches(F.col("supported_features"), "(?i)function|tool")).alias("supports_tool_calling"),
        text.modality_list(F.col("input_modalities")).alias("input_modalities"), text.modality_list(F.col("output_modalities")).alias("output_modalities"),
        "supported_features", "source_url", F.lit(None).cast("string").alias("raw"), "observed_at", F.col("observed_at").alias("created_at"),
    )
    columns = {c: F.col(c) for c in shaped.columns}
    digest = values.capability_hash(
        [columns[c] for c in ("display_name", "family", "stage")], [columns[c] for c in ("context_window", "max_output_tokens")],
        [columns[c] for c in ("supports_vision", "supports_tool_calling")], [columns[c] for c in ("input_modalities", "output_modalities")])
    return shaped.withColumn("content_hash", digest)


def admit_catalog(
    records: DataFrame, manifest: DataFrame, root: str, provider: str, contract: contracts.Contract | None = None, on_ambiguity: str = "flag"
) -> CatalogOutcome:
    """Run announced catalog batches through the gate, resolve their ids to entities, and write snapshots, changes and dimensions.

    An id is an alias, an exact name, the only one of its family, or new; an ambiguous one is reported and not written. Absence of a
    record or field changes nothing.
    """
    spark = records.sparkSession
    gated = gate_batches(records, manifest, root, contract or contracts.catalog_contract(enumerated=True))
    accepted, conflicts = one_per_id(gated.valid)
    accepted = accepted.checkpoint()
    entities, aliases = sinks.read_dimension(spark, root, "dim_entity"), sinks.read_dimension(spark, root, "dim_alias")
    incoming = accepted.select(F.lit(provider).alias("provider"), F.col("model_id").alias("api_id")).distinct()
    resolved = identity.resolve_identities(
        incoming, entities.withColumnRenamed("provider_id", "provider"), aliases.withColumnRenamed("provider_id", "provider"), on_ambiguity)
    fresh = text.canonical_key(F.col("provider"), F.col("api_id"), F.col("api_id"))
    plan = resolved.withColumn("entity_id", F.when(F.col("reason") == "new", fresh).otherwise(F.col("entity_id"))).checkpoint()
    snapshots = snapshot_rows(accepted, plan.filter(F.col("entity_id").isNotNull()), gated.known, provider).checkpoint()
    before, after = gated.states(root, "fact_capability", snapshots, "state", STATE)
    events = diff.diff_capabilities(before, after, ["batch_id", *STATE])
    changes = field_changes(events, gated.decided, "catalog", "capability_changed")
    outcome = gated.write(root, "fact_capability", snapshots, changes, lambda: _upsert(snapshots, root))
    return CatalogOutcome(outcome, conflicts, plan.filter(F.col("entity_id").isNull()))


def _upsert(snapshots: DataFrame, root: str) -> None:
    """Entities and aliases of the snapshots: the first sighting stays, the last advances, names follow the newest sighting."""
    entities, aliases = sinks.read_dimension(snapshots.sparkSession, root, "dim_entity"), sinks.read_dimension(snapshots.sparkSession, root, "dim_alias")
    seen = [F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at")]
    newest = F.struct("observed_at", "snapshot_id")
    sighted = snapshots.groupBy("entity_id").agg(
        *seen, F.max_by("provider_id", newest).alias("provider_id"), F.min("api_id").alias("name"), F.max_by("display_name", newest).alias("display_name"))
    known = ["entity_id", "first_seen_at", "last_seen_at", "provider_id", "name", "display_name"]
    merged = sinks.merge_dimension(entities.select(*known), sighted.select(*known), ["entity_id"], ["provider_id", "display_name"])
    # The name an entity was first known by stays.
    named = entities.select("entity_id", F.col("name").alias("_n")).unionByName(sighted.select("entity_id", F.col("name").alias("_n")).join(entities, "entity_id", "left_anti"))
    rest = entities.drop("first_seen_at", "last_seen_at", "provider_id", "name", "display_name")
    full = merged.join(named.withColumnRenamed("_n", "name"), "entity_id").join(rest, "entity_id", "left")
    sinks.write_dimension(full.withColumn("is_active", F.coalesce("is_active", F.lit(True))), root, "dim_entity")
    keys = ["provider_id", "entity_id", "source_id", "alias"]
    shown = snapshots.select("provider_id", "entity_id", "source_id", F.col("api_id").alias("alias"), F.lit("api_id").alias("alias_type"), "observed_at")
    met = shown.groupBy(*keys).agg(*seen, F.max("alias_type").alias("alias_type"))
    columns = [*keys, "first_seen_at", "last_seen_at", "alias_type"]
    sinks.write_dimension(sinks.merge_dimension(aliases.select(*columns), met.select(*columns), keys, ["alias_type"]), root, "dim_alias")
