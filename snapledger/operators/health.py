"""Source health, fleet counts and dashboard totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.values import age_minutes
from snapledger.operators.gate import OPEN_STATES

RUN_COLUMNS = ("run_id", "status", "started_at", "completed_at", "records_seen", "records_accepted", "records_rejected", "error_message")


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per source as a struct ``run``; reduced on the map side."""
    fields = [c for c in RUN_COLUMNS if c in runs.columns]
    return runs.groupBy("source_id").agg(F.max_by(F.struct(*fields), F.struct("started_at", "run_id")).alias("run"))


def newest_incidents(incidents: DataFrame) -> DataFrame:
    fields = [c for c in incidents.columns if c != "source_id"]
    return incidents.groupBy("source_id").agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "run_id")).alias("incident"))


def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its newest run; a source never collected stays."""
    return sources.join(newest_runs(runs), "source_id", "left")


def health_status(run_status: Column, incident_status: Column, attempts: Column) -> Column:
    """The newest incident outranks the newest run."""
    return (
        F.when(incident_status.isin("open", "healing") & (attempts > 0), "healing")
        .when(incident_status == "open", "quarantined")
        .when(incident_status == "needs_review", "needs_review")
        .when((incident_status == "resolved") & (run_status == "succeeded"), "recovered")
        .when(run_status == "succeeded", "healthy")
        .when(run_status == "partial", "degraded")
        .when(run_status == "failed", "quarantined")
        .otherwise("healthy")
    )


def gate_health(sources: DataFrame, runs: DataFrame, incidents: DataFrame) -> DataFrame:
    joined = source_health(sources, runs).join(newest_incidents(incidents), "source_id", "left")
    status = health_status(F.col("run.status"), F.col("incident.status"), F.col("incident.healing_attempt_count"))
    return joined.withColumn("health", status)


def recovery_stats(incidents: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per source: resolved incidents, last recovery, and repair attempts counted once per (incident, number)."""
    distinct = attempts.select("incident_id", "attempt_number").distinct()
    per_incident = distinct.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    joined = incidents.join(per_incident, "incident_id", "left")
    return joined.groupBy("source_id").agg(
        F.count_if(~F.col("status").isin(*OPEN_STATES)).alias("resolved_incidents"),
        F.max("resolved_at").alias("last_recovered_at"),
        F.sum(F.coalesce("n", F.lit(0))).alias("healing_attempts"),
    )


def freshness(age: Column, limit: Column) -> Column:
    return (
        F.when(age.isNull() | limit.isNull(), "unknown").when(age > limit, "stale")
        .when(age > limit / 2, "aging").otherwise("fresh")
    )


def health_view(sources: DataFrame, runs: DataFrame, incidents: DataFrame, attempts: DataFrame, now: Column,
                max_staleness_minutes: Column) -> DataFrame:
    """Health, freshness and recovery of every source."""
    success = runs.filter(F.col("status") == "succeeded").groupBy("source_id").agg(
        F.max_by(F.coalesce("completed_at", "started_at"), F.struct("started_at", "run_id")).alias("last_success_at"))
    joined = gate_health(sources, runs, incidents).join(success, "source_id", "left").join(
        recovery_stats(incidents, attempts), "source_id", "left")
    age = age_minutes(F.col("last_success_at"), now)
    status = F.col("incident.status")
    return joined.withColumns({
        "age_minutes": age,
        "freshness": freshness(age, max_staleness_minutes),
        "stale_after": F.timestamp_add("MINUTE", max_staleness_minutes.cast("int"), F.col("last_success_at")),
        "has_open_incident": F.coalesce(status.isin(*OPEN_STATES), F.lit(False)),
        "has_past_incident": F.coalesce(~status.isin(*OPEN_STATES), F.lit(False)),
        "resolved_incidents": F.coalesce("resolved_incidents", F.lit(0)).cast("bigint"),
        "healing_attempts": F.coalesce("healing_attempts", F.lit(0)).cast("bigint"),
    })


def fleet_counts(view: DataFrame) -> DataFrame:
    health = F.col("health")

    def state(name: str) -> Column:
        return F.count_if(health == name)

    return view.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_active")).alias("enabled"),
        state("healthy").alias("healthy"),
        state("recovered").alias("recovered"),
        F.count_if(health.isin("healthy", "recovered")).alias("operational"),
        state("degraded").alias("degraded"),
        state("quarantined").alias("quarantined"),
        state("healing").alias("healing"),
        state("needs_review").alias("needs_review"),
        F.count_if(F.col("freshness") == "stale").alias("stale"),
        F.count_if("has_open_incident").alias("open_incidents"),
        F.count_if("has_past_incident").alias("recovered_incidents"),
    )


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Finished, unsuccessful runs per source since its last success.

    Runs are first summed per source and day; only the day of the last success is read run by run. So the runs of a busy source
    never meet in one task.
    """
    order = F.struct("started_at", "run_id")
    counted = ~F.col("status").isin("running", "skipped", "succeeded")
    dated = runs.withColumn("_day", F.to_date("started_at"))
    days = dated.groupBy("source_id", "_day").agg(
        F.count_if(counted).alias("_n"), F.max(F.when(F.col("status") == "succeeded", order)).alias("_ok_on_day"))
    last = days.groupBy("source_id").agg(F.max("_ok_on_day").alias("_ok"))
    later = F.col("_ok").isNull() | F.coalesce(F.col("_day") > F.to_date("_ok.started_at"), F.lit(False))
    whole = days.join(last, "source_id").groupBy("source_id").agg(F.sum(F.when(later, F.col("_n")).otherwise(0)).alias("_n"))
    bound = last.filter(F.col("_ok").isNotNull()).withColumn("_day", F.to_date("_ok.started_at"))
    same = dated.join(bound, ["source_id", "_day"]).filter(counted & (order > F.col("_ok"))).groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    return whole.unionByName(same).groupBy("source_id").agg(F.sum("_n").alias("consecutive_failures"))


def attempt_summary(runs: DataFrame, alert_after: int = 3) -> DataFrame:
    """Last attempt, last finished attempt and last success per source, and whether somebody must look."""
    order = F.struct("started_at", "run_id")
    row = F.struct("run_id", "status", "started_at")
    done = F.col("status") != "running"
    picked = runs.groupBy("source_id").agg(
        F.max_by(row, order).alias("last_attempt"),
        F.max_by(row, F.when(done, order)).alias("last_completed"),
        F.max_by(row, F.when(F.col("status") == "succeeded", order)).alias("last_success"),
    )
    joined = picked.join(consecutive_failures(runs), "source_id")
    alarm = (F.col("consecutive_failures") >= alert_after) | F.coalesce(
        F.col("last_completed.status") == "quarantined", F.lit(False))
    return joined.withColumn("needs_attention", alarm)


def run_health(status: Column) -> Column:
    return F.when(status == "succeeded", "healthy").when(status == "partial", "degraded").when(status == "failed", "down").otherwise("unknown")


def worst_rank(state: Column) -> Column:
    return F.when(state == "down", 3).when(state == "degraded", 2).when(state == "healthy", 1).otherwise(0)


def provider_status(health: DataFrame) -> DataFrame:
    """Worst state among a provider's sources, its source count and accepted records."""
    state = run_health(F.col("run.status"))
    grouped = health.groupBy("provider_id").agg(
        F.max(worst_rank(state)).alias("_rank"),
        F.count(F.lit(1)).alias("sources"),
        F.sum(F.col("run.records_accepted")).alias("accepted_records"),
        F.max(F.col("run.completed_at")).alias("last_collection_at"),
    )
    rank = F.col("_rank")
    worst = F.when(rank == 3, "down").when(rank == 2, "degraded").when(rank == 1, "healthy").otherwise("unknown")
    return grouped.withColumn("status", worst).drop("_rank")


def ecosystem_status(health: DataFrame) -> DataFrame:
    """One status for the whole fleet: a few affected sources leave it operational."""
    state = run_health(F.col("run.status"))
    counted = health.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(state.isin("degraded", "down")).alias("affected"),
        F.count_if(state == "healthy").alias("healthy"),
    )
    allowed = F.greatest(F.lit(1), F.floor(F.col("sources") * 0.2))
    status = (
        F.when(F.col("sources") == 0, "unknown")
        .when(F.col("affected") == 0, F.when(F.col("healthy") > 0, "healthy").otherwise("unknown"))
        .when(F.col("affected") <= allowed, "operational").otherwise("degraded")
    )
    return counted.withColumn("status", status)


def dashboard_totals(current_prices: DataFrame, entities: DataFrame, changes: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Headline numbers, each input reduced to one row on its own."""
    def within(hours: int) -> Column:
        return F.unix_micros(F.col("detected_at")) >= F.unix_micros(now) - hours * 3_600_000_000

    priced = current_prices.select("entity_id").distinct().agg(F.count(F.lit(1)).alias("priced_entities"))
    known = entities.agg(F.count(F.lit(1)).alias("entities"))
    kind = F.col("change_type")
    moved = changes.agg(
        F.count_if(within(24)).alias("changes_24h"),
        F.count_if(within(168) & kind.isin("price_increased", "price_decreased")).alias("price_changes_7d"),
        F.count_if(within(168) & kind.isin("lifecycle_changed", "model_removed")).alias("lifecycle_changes_7d"),
    )
    alarms = health.agg(
        F.count_if(F.col("run.status") == "failed").alias("active_alerts"),
        F.max("run.completed_at").alias("last_refresh"),
    )
    # Each part is one row with its own columns; stacked and reduced once, they need no join.
    stacked = priced
    for part in (known, moved, alarms):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def fleet_run_status(attempts: DataFrame) -> DataFrame:
    """Outcome of one fleet pass from the statuses of its attempts."""
    status = F.col("status")
    counted = attempts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "quarantined").alias("quarantined"),
        F.count_if(status == "skipped").alias("skipped"),
    )
    executed = F.col("total") - F.col("skipped")
    outcome = (
        F.when(executed == 0, "noop").when(F.col("succeeded") == executed, "completed")
        .when(F.col("succeeded") == 0, "failed").otherwise("partial")
    )
    return counted.withColumn("outcome", outcome)


def degraded_providers(health: DataFrame) -> DataFrame:
    """Providers with an active price or catalog source whose newest run failed in full or in part."""
    hit = (
        F.col("is_active").eqNullSafe(True) & F.col("kind").isin("models", "pricing")
        & F.col("run.status").isin("failed", "partial")
    )
    return health.filter(hit).select("provider_id").distinct()


def match_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Each configured source with its health row: by URL, else by provider and kind."""
    by_url = health.groupBy("source_url").agg(F.min_by(F.struct("source_id", "health"), "source_id").alias("u"))
    by_kind = health.groupBy("provider_id", "kind").agg(F.min_by(F.struct("source_id", "health"), "source_id").alias("k"))
    joined = sources.join(by_url, "source_url", "left").join(by_kind, ["provider_id", "kind"], "left")
    return joined.withColumn("match", F.coalesce("u", "k")).drop("u", "k")


def run_view(runs: DataFrame) -> DataFrame:
    """Validation status and duration of each run."""
    status = F.col("status")
    validation = (
        F.when(status == "running", "pending").when(status == "failed", "failed")
        .when(F.col("records_rejected") > 0, "partial").otherwise("passed")
    )
    elapsed = F.unix_millis("completed_at") - F.unix_millis("started_at")
    return runs.withColumns({
        "validation": validation,
        "duration_ms": F.when(F.col("completed_at").isNotNull(), F.greatest(elapsed, F.lit(0))),
    })
