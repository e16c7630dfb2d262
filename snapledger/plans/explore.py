"""Current evidence per entity, assembled from the histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.operators import current, explorer
from snapledger.operators.ordered import latest


def current_entries(
    entities: DataFrame, prices: DataFrame, capabilities: DataFrame, lifecycle: DataFrame, now: Column,
    price_order: list[str], lifecycle_order: list[str], standard_mode: str = "standard",
    standard_tiers: tuple[str, ...] = current.STANDARD_TIERS, shown: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Entries of :func:`snapledger.operators.explorer.entries` from raw histories.

    Only the columns an entry shows are carried through the shuffles. ``shown`` adds what derives from the stored columns of ``prices``
    to the picked rows, at most one row for each: the pick sorts every price, so rows without these texts keep it in memory.
    """
    wanted = ["entity_id", "mode", "tier", "snapshot_id", "input", "cached", "output", "currency", "pricing_unit", "source_url"]
    rows = prices.select(*dict.fromkeys([*wanted, *price_order])) if shown is None else prices
    quoted = current.newest_primary(rows, price_order, ["entity_id"], standard_mode, standard_tiers)
    quoted = quoted if shown is None else shown(quoted)
    price_side = quoted.select(
        "entity_id", F.col("mode").alias("price_mode"), F.col("tier").alias("price_tier"),
        F.col("snapshot_id").alias("price_snapshot_id"), F.col("input").alias("input_price"),
        F.col("cached").alias("cached_price"), F.col("output").alias("output_price"), "currency", "pricing_unit",
        F.col("source_url").alias("price_url"), F.col("observed_at").alias("price_observed_at"),
    )
    capability_side = current.resolve_capabilities(capabilities, ["entity_id"], ["observed_at", "api_id"], [
        *current.CAPABILITY_VALUES, "api_id"]).withColumnRenamed("observed_at", "capability_observed_at")
    state = latest(lifecycle, ["entity_id"], lifecycle_order)
    lifecycle_side = state.select(
        "entity_id", F.col("state").alias("lifecycle_state"), "deprecated_on", "retirement_date", "not_before_date",
        "replacement", F.col("observed_at").alias("lifecycle_observed_at"),
    )
    return explorer.entries(entities, price_side, capability_side, lifecycle_side, now)
