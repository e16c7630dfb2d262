"""Current state: which of many observations is the one to serve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.operators.ordered import latest

# Runs whose rows may serve as a comparison baseline.
COMPARABLE_STATUSES = ("succeeded", "partial")


def latest_comparable(
    snapshots: DataFrame, runs: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Latest row per key among runs that succeeded, fully or in part."""
    usable = runs.filter(F.col("status").isin(*COMPARABLE_STATUSES)).select("run_id")
    return latest(snapshots.join(usable, "run_id", "left_semi"), keys, order)


def as_of(snapshots: DataFrame, keys: Sequence[str], order: Sequence[str], until: str, since: str | None = None,
          time_column: str = "observed_at") -> DataFrame:
    """The state known just before ``until``, optionally from observations at or after ``since``."""
    rows = _before(snapshots, until, time_column)
    if since is not None:
        bound = F.lit(since).cast("timestamp")
        rows = rows.filter(F.col(time_column) >= bound)
        rows = rows.filter(F.col("month") >= F.date_format(bound, "yyyy-MM")) if "month" in rows.columns else rows
    return latest(rows, keys, order)


def _before(snapshots: DataFrame, until: str, time_column: str) -> DataFrame:
    """Rows before an instant; on a ledger table only the folders of the months up to it are read."""
    bound = F.lit(until).cast("timestamp")
    rows = snapshots.filter(F.col(time_column) < bound)
    return rows.filter(F.col("month") <= F.date_format(bound, "yyyy-MM")) if "month" in rows.columns else rows


def as_of_pairs(snapshots: DataFrame, keys: Sequence[str], order: Sequence[str], cut: str, until: str,
                time_column: str = "observed_at") -> DataFrame:
    """The states before ``cut`` and from ``cut`` to before ``until`` side by side as ``p`` and ``c``.

    Both come from one scan and one shuffle: two picks of the same aggregate instead of two states and a
    full outer join.
    """
    values = [c for c in snapshots.columns if c not in keys]
    at, row = F.col(time_column), F.struct(*order)
    rows = _before(snapshots, until, time_column)
    early = at < F.lit(cut).cast("timestamp")
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.when(early, row)).alias("p"),
        F.max_by(F.struct(*values), F.when(~early, row)).alias("c"),
    )


# Context tiers that price an ordinary request, best first.
STANDARD_TIERS = ("default", "short", "base", "standard")
LONG_TIER = r"(?i)long|extended|large|\b>\s*\d"


def is_long_tier(tier: Column) -> Column:
    return tier.rlike(LONG_TIER)


def tier_rank(tier: Column, standard: Sequence[str] = STANDARD_TIERS) -> Column:
    """Lower is more ordinary: known tiers by position, then unknown names, then surcharge tiers."""
    place = F.array_position(F.array(*[F.lit(t) for t in standard]), F.lower(F.trim(tier)))
    return F.when(place > 0, place.cast("int") - 1).when(is_long_tier(tier), 100).otherwise(50)


def primary_tier(
    tiers: DataFrame,
    entity: Sequence[str] = ("entity_id",),
    standard_mode: str = "standard",
    standard_tiers: Sequence[str] = STANDARD_TIERS,
) -> DataFrame:
    """The tier a general price quotes. Chosen by name only, never by price.

    A rank filter, so only the columns a caller uses travel through it and through what comes before.
    """
    rank = [
        F.when(F.col("mode") == standard_mode, 0).otherwise(1),
        tier_rank(F.col("tier"), standard_tiers),
        F.col("mode"),
        F.col("tier"),
    ]
    rest = [c for c in tiers.columns if c not in entity]
    numbered = tiers.withColumn("_rn", F.row_number().over(Window.partitionBy(*entity).orderBy(*rank)))
    return numbered.filter("_rn = 1").select(*entity, *rest)


def newest_primary(
    prices: DataFrame,
    order: Sequence[str],
    entity: Sequence[str] = ("entity_id",),
    standard_mode: str = "standard",
    standard_tiers: Sequence[str] = STANDARD_TIERS,
) -> DataFrame:
    """The newest row of the tier a general price quotes, as :func:`primary_tier` of the newest rows per (entity, mode, tier).

    The tier is chosen by name, so both choices are one order within an entity: a task sends one row per entity that it read, and there
    is one shuffle.
    """
    place = F.when(F.col("mode") == standard_mode, 0).otherwise(1) * (1 << 20) + tier_rank(F.col("tier"), standard_tiers)
    # A column, so that comparing two rows does not derive their places again.
    ranked = prices.withColumn("_place", place)
    first = Window.partitionBy(*entity).orderBy("_place", "mode", "tier", *[F.col(c).desc() for c in order])
    numbered = ranked.withColumn("_rn", F.row_number().over(first))
    return numbered.filter("_rn = 1").select(*prices.columns)


CAPABILITY_VALUES = [
    "display_name", "family", "stage", "context_window", "max_output_tokens", "supports_vision",
    "supports_tool_calling", "input_modalities", "output_modalities", "statement",
]


def capability_fingerprint(columns: Sequence[str] = CAPABILITY_VALUES, arrays: Sequence[str] = ("input_modalities", "output_modalities")) -> Column:
    """One comparable text per capability row; NULL and empty differ, array order does not matter."""
    parts = [F.array_sort(F.col(c)).alias(c) if c in arrays else F.col(c) for c in columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def resolve_capabilities(
    rows: DataFrame, entity: Sequence[str], order: Sequence[str], values: Sequence[str] = CAPABILITY_VALUES
) -> DataFrame:
    """One capability row per entity, or all NULL and ``conflicted`` when its current rows disagree.

    Disagreement is min <> max of the fingerprint, so it aggregates on the map side like any minimum.
    """
    arrays = [c for c, kind in rows.dtypes if c in values and kind.startswith("array")]
    grouped = rows.withColumn("_fp", F.md5(capability_fingerprint(values, arrays))).groupBy(*entity).agg(
        (F.min("_fp") != F.max("_fp")).alias("conflicted"),
        F.max_by(F.struct(*values, "observed_at"), F.struct(*order)).alias("_row"),
    )
    picked = [F.when(~F.col("conflicted"), F.col("_row")[c]).alias(c) for c in [*values, "observed_at"]]
    return grouped.select(*entity, "conflicted", *picked)


def furthest_repair(attempts: DataFrame) -> DataFrame:
    """One row per (incident, attempt number): the furthest outcome, then the latest start."""
    ranked = attempts.withColumn("outcome", repair_outcome(F.col("status")))
    progress = outcome_progress(F.col("outcome"))
    return (
        ranked.groupBy("incident_id", "attempt_number")
        .agg(F.max_by(F.struct("attempt_id", "status", "outcome", "started_at"),
                      F.struct(progress, "started_at", "attempt_id")).alias("_row"))
        .select("incident_id", "attempt_number", "_row.*")
    )


def repair_outcome(status: Column) -> Column:
    # Repair status -> outcome.
    return (
        F.when(status.isin("initiated", "in_progress", "awaiting_approval"), "in_progress")
        .when(status.isin("candidate_validated", "approved"), "recovered")
        .when(status.isin("candidate_rejected", "rejected"), "rejected")
        .when(status == "timed_out", "needs_review")
        .otherwise("failed")
    )


def outcome_progress(outcome: Column) -> Column:
    # How far an outcome is.
    return (
        F.when(outcome == "in_progress", 0).when(outcome == "failed", 1).when(outcome == "needs_review", 2)
        .when(outcome == "rejected", 3).when(outcome == "recovered", 4)
    )


def newest_domain(domains: Sequence[tuple[str, Column]]) -> Column:
    """Struct (domain, at) of the newest non-null time; a tie goes to the domain listed first."""
    entries = F.array(*[
        F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(-i).alias("o"), F.lit(d).alias("domain")))
        for i, (d, at) in enumerate(domains)
    ])
    return F.array_max(F.filter(entries, lambda e: e.isNotNull()))


def fold_lifecycle(observations: DataFrame, entity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Entity lifecycle after applying its observations in order.

    Each field keeps the last value somebody asserted. The exact retirement date and its lower bound move
    as one pair: whichever was asserted last clears the other. Every field is one ``max_by`` over the
    rows that assert it, so a long history of one entity is reduced on the map side.
    """
    at = F.struct(*order)

    def last_asserted(value: Column, asserts: Column) -> Column:
        return F.max_by(value, F.when(asserts, at))

    exact = F.col("retirement_date").isNotNull()
    bound = ~exact & (F.col("not_before_observation") == "date") & F.col("not_before_date").isNotNull()
    cleared = ~exact & (F.col("not_before_observation") == "explicitly_unannounced")
    return observations.groupBy(*entity).agg(
        last_asserted(F.col("state"), F.col("state").isNotNull()).alias("lifecycle_state"),
        last_asserted(F.col("deprecated_on"), F.col("deprecated_on").isNotNull()).alias("deprecated_on"),
        # An unannounced bound leaves the exact date alone, so the two sides fold over different rows.
        last_asserted(F.col("retirement_date"), exact | bound).alias("retirement_date"),
        last_asserted(F.when(bound, F.col("not_before_date")), exact | bound | cleared)
        .alias("retirement_not_before_date"),
        F.max("observed_at").alias("lifecycle_observed_at"),
    ).withColumn(
        "is_active", F.when(F.col("lifecycle_state").isNull(), True).otherwise(F.col("lifecycle_state") != "retired")
    )
