"""Everything kept about one source or one entity, as rows (id, item, ref, rn) for all of them at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators.ordered import latest, top_per_key


def _newest(rows: DataFrame, key: str, order: Sequence[str], limit: int, item: str, ref: str) -> DataFrame:
    ranked = top_per_key(rows.select(key, ref, *[c for c in order if c not in (key, ref)]), [key], [F.col(c).desc() for c in order], limit, "rn")
    return ranked.select(key, F.lit(item).alias("item"), F.col(ref).cast("string").alias("ref"), "rn")


def source_detail(
    runs: DataFrame, incidents: DataFrame, repairs: DataFrame, observations: DataFrame, identity: Sequence[str], order: Sequence[str],
    newest: int = 5, observed: int = 20,
) -> DataFrame:
    """Per source: its newest runs, incidents and repair attempts, and of its newest observations one per identity."""
    attempts = repairs.join(incidents.select("incident_id", "source_id"), "incident_id")
    seen = observations.join(runs.select("run_id", "source_id"), "run_id")
    recent = top_per_key(seen, ["source_id"], [F.col(c).desc() for c in order], observed, "rn").drop("rn")
    first = latest(recent, ["source_id", *identity], order)
    return (
        _newest(runs, "source_id", ["started_at", "run_id"], newest, "run", "run_id")
        .unionByName(_newest(incidents, "source_id", ["created_at", "run_id"], newest, "incident", "incident_id"))
        .unionByName(_newest(attempts, "source_id", ["started_at", "attempt_id"], newest, "repair", "attempt_id"))
        .unionByName(_newest(first, "source_id", order, observed, "observation", "snapshot_id"))
    )


def entity_detail(
    prices: DataFrame, lifecycle: DataFrame, capabilities: DataFrame, changes: DataFrame, identity: Sequence[str], order: Sequence[str],
    history: int = 100, recent_changes: int = 50,
) -> DataFrame:
    """Per entity: current prices, price, lifecycle and capability histories, newest changes, and API ids.

    Pass only changes whose snapshots are admissible (see :func:`snapledger.operators.provenance.trusted_events`).
    """
    scope = [c for c in identity if c != "entity_id"]
    now = top_per_key(latest(prices, identity, order).select(*identity, "snapshot_id"), ["entity_id"], [F.col(c).asc() for c in scope], 1 << 30, "rn")
    ids = lifecycle.select("entity_id", "api_id").distinct()
    return (
        _newest(prices, "entity_id", order, history, "price", "snapshot_id")
        .unionByName(_newest(lifecycle, "entity_id", ["observed_at", "run_id"], history, "lifecycle", "snapshot_id"))
        .unionByName(_newest(capabilities, "entity_id", ["observed_at", "snapshot_id"], history, "capability", "snapshot_id"))
        .unionByName(_newest(changes, "entity_id", ["detected_at", "event_id"], recent_changes, "change", "event_id"))
        .unionByName(now.select("entity_id", F.lit("current").alias("item"), F.col("snapshot_id").alias("ref"), "rn"))
        .unionByName(ids.select("entity_id", F.lit("api_id").alias("item"), F.col("api_id").alias("ref"), F.lit(1).alias("rn")))
    )
