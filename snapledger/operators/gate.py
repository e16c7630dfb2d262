"""Batch admission: all of a batch is admitted or none of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.values import to_fixed
from snapledger.operators.contracts import DUPLICATE, ENUM, SCHEMA, Contract
from snapledger.operators.ordered import last_before

COLLAPSE, SPIKE, EMPTY, CRASH = (
    "RECORD_COUNT_COLLAPSE", "RECORD_COUNT_SPIKE", "ZERO_RECORDS", "COLLECTOR_EXECUTION_FAILURE")
# Severity of reason codes, and a spike needs more records than this.
CRITICAL = (CRASH, EMPTY, COLLAPSE)
WARNING = (SCHEMA, ENUM, "ALL_PRICES_NULL", "SEMANTIC_INVARIANT_VIOLATION", "CAPABILITY_TOKEN_LIMITS_MISSING", DUPLICATE)
SPIKE_FLOOR = 10
# Health states and the states each may change to.
TRANSITIONS = {
    "healthy": ("healthy", "degraded", "quarantined"),
    "degraded": ("healthy", "degraded", "quarantined"),
    "quarantined": ("healing", "needs_review", "healthy", "recovered"),
    "healing": ("recovered", "quarantined", "needs_review"),
    "recovered": ("healthy", "degraded", "quarantined"),
    "needs_review": ("healing", "healthy", "quarantined"),
}
OPEN_STATES = ("open", "healing", "needs_review")


def batch_evidence(validated: DataFrame, contract: Contract, batch: str = "batch_id", position: str = "position") -> DataFrame:
    """Counts, fault codes and broken invariants per batch.

    Grouped by (batch, identity) first and by batch second: both levels combine on the map side, so a
    batch holding a third of all records, or one identity repeated that often, stays spread out.
    """
    inputs = list(dict.fromkeys(name for i in contract.invariants for name in i.inputs))
    ok = F.col("schema_ok")
    identity = [F.when(ok, F.col(k)).alias(f"_k{n}") for n, k in enumerate(contract.key)]
    first = F.min_by(F.struct(*[F.col(c) for c in inputs] or [F.lit(0).alias("_none")]), F.when(ok, F.col(position)))
    per_identity = validated.groupBy(batch, ok.alias("_ok"), *identity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or("enum_fault").alias("_enum"),
        first.alias("_first"),
    )
    flat = per_identity.select(batch, "_ok", "_n", "_enum", *[F.col("_first")[c].alias(c) for c in inputs])

    def valid(condition: Column) -> Column:
        return F.when(F.col("_ok"), condition)

    counted = flat.groupBy(batch).agg(
        F.sum("_n").alias("records_seen"),
        F.count_if("_ok").alias("records_valid"),
        F.sum(F.when(F.col("_ok"), F.col("_n") - 1).otherwise(0)).alias("duplicates"),
        F.bool_or("_enum").alias("_any_enum"),
        *[F.coalesce(i.broken(valid), F.lit(False)).alias(f"_i{n}") for n, i in enumerate(contract.invariants)],
    )
    invalid = F.col("records_seen") - F.col("records_valid")
    schema_faults = invalid - F.col("duplicates") > 0
    has_valid = F.col("records_valid") > 0
    codes = [
        F.when(schema_faults, SCHEMA),
        F.when(F.col("_any_enum"), ENUM),
        F.when(F.col("duplicates") > 0, DUPLICATE),
        *[F.when(F.col(f"_i{n}") & has_valid, i.code) for n, i in enumerate(contract.invariants)],
    ]
    broken = F.lit(False)
    for n in range(len(contract.invariants)):
        broken = broken | F.col(f"_i{n}")
    return counted.select(
        batch, "records_seen", "records_valid", invalid.alias("records_invalid"), "duplicates",
        F.filter(F.array(*codes), lambda c: c.isNotNull()).alias("record_codes"),
        (has_valid & broken).alias("invariant_broken"),
    )


def baselines(runs: DataFrame, segment: Column) -> DataFrame:
    """Per run, the newest fully succeeded run of its source before it (``lkg``). Partial runs do not count."""
    value = F.struct("run_id", F.col("records_accepted").alias("count"), F.coalesce("completed_at", "started_at").alias("at"))
    return last_before(runs, ["source_id"], ["started_at", "run_id"], segment, value, "lkg", F.col("status") == "succeeded")


def current_baseline(runs: DataFrame) -> DataFrame:
    """The newest fully succeeded run per source, for admitting a batch that arrives now."""
    value = F.struct("run_id", F.col("records_accepted").alias("count"), F.coalesce("completed_at", "started_at").alias("at"))
    done = runs.filter(F.col("status") == "succeeded")
    return done.groupBy("source_id").agg(F.max_by(value, F.struct("started_at", "run_id")).alias("lkg"))


def decide(manifest: DataFrame, evidence: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The admission decision of every announced batch.

    ``manifest`` holds one row per batch, also for one that returned nothing, with ``collector_error``,
    ``baseline_count`` and the contract limits as columns. Empty batches exist only there.
    """
    joined = manifest.join(evidence, batch, "left")
    crashed = F.col("collector_error").isNotNull()

    def count(name: str) -> Column:
        return F.when(crashed, 0).otherwise(F.coalesce(name, F.lit(0))).cast("bigint")

    rows = joined.withColumns({c: count(c) for c in ("records_seen", "records_valid", "records_invalid", "duplicates")})
    seen, valid, invalid = F.col("records_seen"), F.col("records_valid"), F.col("records_invalid")
    empty = ~crashed & (seen == 0)
    full = ~crashed & (seen > 0)
    prev = F.col("baseline_count")
    compared = full & F.coalesce(prev > 0, F.lit(False))
    drop, growth = F.try_divide(prev - valid, prev), F.try_divide(valid, prev)
    collapse = compared & (prev >= F.col("min_expected")) & (drop >= F.col("max_drop"))
    spike = compared & ~collapse & (valid > SPIKE_FLOOR) & (growth >= F.col("max_spike"))
    rows = rows.withColumns({
        "invalid_ratio": F.coalesce(F.try_divide(invalid, seen), F.lit(0.0)),
        "over_budget": full & (invalid > 0) & (F.coalesce(F.try_divide(invalid, seen), F.lit(0.0)) >= F.col("quarantine_ratio")),
        "below_minimum": full & (valid < F.col("min_viable")),
        "collapsed": F.coalesce(collapse, F.lit(False)),
        "spiked": F.coalesce(spike, F.lit(False)),
        "broke_invariant": full & F.coalesce("invariant_broken", F.lit(False)),
    })
    drift = F.when(F.col("collapsed"), "collapse").when(F.col("spiked"), "spike").when(compared, "within_tolerance")
    percent = F.when(F.col("collapsed"), -drop * 100).when(F.col("spiked"), (growth - 1) * 100).when(
        compared, F.try_divide(valid - prev, prev) * 100)
    refused = (
        crashed | (empty & (F.col("min_viable") > 0)) | F.col("over_budget") | F.col("below_minimum")
        | F.col("collapsed") | F.col("spiked") | F.col("broke_invariant")
    )
    codes = F.array_compact(F.concat(
        F.array(
            F.when(crashed, CRASH), F.when(empty, EMPTY),
            F.when(F.col("below_minimum") | F.col("collapsed"), COLLAPSE), F.when(F.col("spiked"), SPIKE),
        ),
        F.when(full, F.coalesce("record_codes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
    ))
    decided = rows.withColumns({
        "drift_type": drift,
        "drift_percent": percent,
        "refused": refused,
        "reason_codes": F.array_sort(F.array_distinct(codes)),
    })
    status = F.when(F.col("refused"), "quarantined").when(invalid > 0, "degraded").otherwise("healthy")
    labelled = decided.withColumn("status", status).withColumn("severity", severity(F.col("reason_codes")))
    return labelled.withColumn("summary", decision_summary()).drop("record_codes", "invariant_broken")


def severity(codes: Column) -> Column:
    def any_of(names: Sequence[str]) -> Column:
        return F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))

    return F.when(any_of(CRITICAL), "critical").when(any_of(WARNING), "warning").otherwise("info")


def decision_summary() -> Column:
    seen, valid, invalid = (F.col(c).cast("string") for c in ("records_seen", "records_valid", "records_invalid"))
    rate = F.format_string("%.1f", to_fixed(F.col("invalid_ratio") * 100, 1))
    return (
        F.when(F.col("collector_error").isNotNull(), F.concat(F.lit("Collector execution failed: "), "collector_error"))
        .when(F.col("records_seen") == 0, "Collector output contains zero records")
        .when(F.col("status") == "healthy", F.concat(F.lit("Evaluated "), seen, F.lit(" records: 100% valid. Source healthy.")))
        .when(F.col("status") == "degraded", F.concat(
            F.lit("Evaluated "), seen, F.lit(" records: "), valid, F.lit(" valid, "), invalid, F.lit(" rejected ("), rate,
            F.lit("% error rate). Source degraded within tolerance.")))
        .otherwise(F.concat(
            F.lit("Quarantined: "), invalid, F.lit("/"), seen, F.lit(" invalid records. Anomaly triggers: ["),
            F.coalesce(F.nullif(F.array_join("reason_codes", ", "), F.lit("")), F.lit("VALIDATION_FAILURE")), F.lit("].")))
    )


def admitted(valid_records: DataFrame, decisions: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Valid records of the batches that were let in."""
    return valid_records.join(decisions.filter(~F.col("refused")).select(batch), batch, "left_semi")


def quarantined(validated: DataFrame, decisions: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Every raw record of the refused batches, one row each, with its issues."""
    return validated.join(decisions.filter("refused").select(batch), batch, "left_semi")


def open_incidents(decisions: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One incident per refused batch."""
    expected = F.coalesce("baseline_count", F.col("min_viable").cast("bigint"))
    return decisions.filter("refused").select(
        F.concat(F.lit("incident-"), F.col(batch).cast("string")).alias("incident_id"),
        "source_id", F.col(batch).alias("run_id"), F.lit("open").alias("status"), "severity", "reason_codes", "summary",
        "records_seen", "records_valid", "records_invalid", expected.alias("expected_count"),
        F.col("baseline_count").alias("lkg_count"),
    )


def resolve_incidents(incidents: DataFrame, admitted_runs: DataFrame) -> DataFrame:
    """The newest open incident of each source and the first admitted run after it, which resolves it."""
    newest = incidents.filter(F.col("status").isin(*OPEN_STATES)).groupBy("source_id").agg(
        F.max_by(F.struct("incident_id", "created_at"), F.struct("created_at", "run_id")).alias("i")
    )
    first = first_run_from(admitted_runs, newest.select("source_id", F.col("i.created_at").alias("bound")))
    return newest.join(first, "source_id").select(
        "source_id", "i.incident_id", F.col("r.run_id").alias("resolved_by"), F.col("r.started_at").alias("resolved_at"))


def first_run_from(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """The first run ``r`` of each source at or after its ``bound`` (source_id, bound).

    Runs are first reduced to one per source and day; only the day of the bound is read run by run. So the runs of a busy source
    never meet in one task.
    """
    pick = F.min_by(F.struct("run_id", "started_at"), F.struct("started_at", "run_id")).alias("r")
    dated = runs.select("source_id", "run_id", "started_at", F.to_date("started_at").alias("_day"))
    bound_day = F.to_date("bound")
    whole = dated.groupBy("source_id", "_day").agg(pick).join(bounds, "source_id").filter(F.col("_day") > bound_day).select("source_id", "r.*")
    same = dated.join(bounds.withColumn("_day", bound_day), ["source_id", "_day"]).filter(F.col("started_at") >= F.col("bound"))
    return whole.unionByName(same.select("source_id", "run_id", "started_at")).groupBy("source_id").agg(pick)


def recovery_runs(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest resolved incident per source and the first accepted run at or after its resolution."""
    resolved = incidents.filter((F.col("status") == "resolved") & F.col("resolved_at").isNotNull())
    newest = resolved.groupBy("source_id").agg(
        F.max_by(F.struct("incident_id", "run_id", "resolved_at"), F.struct("resolved_at", "run_id")).alias("i")
    )
    usable = runs.filter(F.col("status").isin("succeeded", "partial") & (F.col("records_accepted") > 0))
    others = usable.join(newest.select("source_id", F.col("i.run_id").alias("run_id")), ["source_id", "run_id"], "left_anti")
    first = first_run_from(others, newest.select("source_id", F.col("i.resolved_at").alias("bound")))
    return newest.join(first, "source_id", "left").select(
        "source_id", "i.incident_id", "i.resolved_at", F.col("r.run_id").alias("recovery_run"), F.col("r.started_at").alias("recovered_at")
    )


def may_follow(before: Column, after: Column) -> Column:
    allowed = before == after
    for state, nexts in TRANSITIONS.items():
        allowed = allowed | ((before == state) & after.isin(*nexts))
    return allowed


def illegal_transitions(history: DataFrame, segment: Column, keys: Sequence[str] = ("source_id",),
                        order: Sequence[str] = ("at", "run_id")) -> DataFrame:
    """State changes of a health history that the rules do not allow."""
    paired = last_before(history, keys, order, segment, F.col("state"), "before")
    return paired.filter(F.col("before").isNotNull() & ~may_follow(F.col("before"), F.col("state")))
