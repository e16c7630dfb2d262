"""Ingest: raw price batches through the gate into the ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions import text, values
from snapledger.operators import contracts, current, diff, gate
from snapledger.operators.ordered import latest
from snapledger.session import ensure_checkpoint_dir
from snapledger.sources import sinks, state

RAW_NAMES = {
    "input_price_per_1m_tokens": "input_price",
    "cached_input_price_per_1m_tokens": "cached_input_price",
    "cache_write_price_per_1m_tokens": "cache_write_price",
    "output_price_per_1m_tokens": "output_price",
}
STATE = ["source_id", "entity_id", "mode", "tier"]


def contract_records(raw: DataFrame, default_url: str) -> DataFrame:
    """Raw price JSON under the column names of the price contract, with source defaults filled in."""
    named = raw.withColumnsRenamed({k: v for k, v in RAW_NAMES.items() if k in raw.columns})
    return text.with_source_defaults(named, default_url)


def with_limits(manifest: DataFrame, limits: contracts.Limits) -> DataFrame:
    return manifest.withColumns({
        "min_viable": F.lit(limits.min_viable), "min_expected": F.lit(limits.min_expected),
        "max_drop": F.lit(limits.max_drop), "max_spike": F.lit(limits.max_spike),
        "quarantine_ratio": F.lit(limits.quarantine_ratio),
    })


def snapshot_rows(valid: DataFrame, manifest: DataFrame) -> DataFrame:
    """Valid records as price snapshots."""
    prices = {"input": "input_price", "cached": "cached_input_price", "cache_write": "cache_write_price", "output": "output_price"}
    money = {n: F.col(c).cast("decimal(20,8)") for n, c in prices.items()}
    runs = manifest.select("batch_id", "source_id", F.col("started_at").alias("observed_at"))
    rows = valid.join(runs, "batch_id")
    entity = text.canonical_key(F.col("provider"), F.col("model_name"), F.col("model_name"))
    named = rows.withColumns(money).withColumn("currency", F.lit("USD"))
    return named.select(
        F.concat_ws("/", "batch_id", entity, "pricing_mode", "context_tier").alias("snapshot_id"),
        F.col("batch_id").alias("run_id"), "source_id", F.col("provider").alias("provider_id"), entity.alias("entity_id"),
        F.col("pricing_mode").alias("mode"), F.col("context_tier").alias("tier"), *money, "currency", "pricing_unit", "source_url",
        F.lit(None).cast("string").alias("raw"),
        values.price_hash([F.col(c) for c in money], F.col("currency"), F.col("pricing_unit")).alias("content_hash"),
        "observed_at", F.col("observed_at").alias("created_at"),
    )


def last_shown(snapshots: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """What the newest comparable run of each source showed: the stored rows its first new batch is compared with."""
    usable = runs.filter(F.col("status").isin(*current.COMPARABLE_STATUSES)).join(sources, "source_id", "left_semi")
    newest = usable.groupBy("source_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return snapshots.join(newest, ["source_id", "run_id"], "left_semi")


def decide_in_order(known: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decisions of several batches per source, each judged against the newest good batch before it.

    A batch's baseline depends on the decisions of the batches before it. Decisions are made for all batches at once, baselines are
    taken from them, and both are repeated until nothing changes: after n rounds the first n batches of every source are final, and
    usually few rounds are needed; there are never more than a
    source has batches. A batch whose external run was admitted earlier in the manifest is a replay and is dropped.

    ``known`` has the stored baseline as ``lkg`` (run_id, count, at); the result has that of each batch.
    """
    order = ["started_at", "batch_id"]
    turn = Window.partitionBy("source_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("source_id", "external_run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row per batch: what the rules need, nothing of the records.
    fixed = known.join(evidence, "batch_id", "left").withColumn("_stored", F.col("lkg")).checkpoint()
    facts = [c for c in evidence.columns if c != "batch_id"]
    rows = fixed.withColumn("_replay", F.lit(False))
    for _ in count():
        held = rows.withColumn("baseline_count", F.col("lkg.count").cast("bigint"))
        decided = gate.decide(held.drop(*facts), held.select("batch_id", *facts))
        good = ~F.col("refused") & ~F.col("_replay")
        clean = good & (F.col("records_invalid") == 0)
        own = F.struct(F.col("batch_id").alias("run_id"), F.col("records_valid").alias("count"), F.col("started_at").alias("at"))
        stated = decided.withColumns({
            "_lkg": F.coalesce(F.last(F.when(clean, own), ignorenulls=True).over(turn), F.col("_stored")),
            "_again": F.coalesce(F.max(good).over(same), F.lit(False)) & F.col("external_run_id").isNotNull(),
        }).checkpoint()
        moved = ~F.col("_lkg.run_id").eqNullSafe(F.col("lkg.run_id")) | (F.col("_again") != F.col("_replay"))
        if stated.filter(moved).isEmpty():
            return stated.filter(~F.col("_replay")).drop("_lkg", "_again", "_replay", "_stored")
        rows = fixed.drop("lkg").join(stated.select("batch_id", F.col("_lkg").alias("lkg"), F.col("_again").alias("_replay")), "batch_id")


def compared_states(
    stored: DataFrame, snapshots: DataFrame, decided: DataFrame, previous: str, identity: Sequence[str] = STATE
) -> tuple[DataFrame, DataFrame]:
    """(previous, current) rows of every admitted batch, named by ``batch_id``; the first batch meets the stored state.

    ``last_run`` compares with the batch before. ``state`` compares with the newest row of every identity, so a row also stands for
    the batches after it that do not show its identity.
    """
    turn = Window.partitionBy("source_id").orderBy("started_at", "batch_id")
    admitted = decided.filter(~F.col("refused"))
    turns = admitted.select("batch_id", "source_id", F.row_number().over(turn).alias("_turn"))
    ends = turns.groupBy("source_id").agg(F.max("_turn").alias("_end"))
    current_rows = snapshots.join(turns.drop("source_id"), snapshots["run_id"] == turns["batch_id"])
    every = current_rows.drop("batch_id").unionByName(stored.select(*snapshots.columns).withColumn("_turn", F.lit(0))).join(ends, "source_id")
    if previous == "last_run":
        last = F.col("_turn") + 1
    else:
        following = F.lead("_turn").over(Window.partitionBy(*identity).orderBy("_turn"))
        every = every.withColumn("_next", following)
        last = F.coalesce("_next", "_end")
    reached = every.filter(F.col("_turn") < F.col("_end")).withColumn("_for", F.explode(F.sequence(F.col("_turn") + 1, last)))
    named = turns.select(F.col("source_id").alias("_s"), F.col("_turn").alias("_t"), "batch_id")
    before = reached.join(named, (F.col("source_id") == F.col("_s")) & (F.col("_for") == F.col("_t")))
    return before.select("batch_id", *snapshots.columns), current_rows.select("batch_id", *snapshots.columns)


@dataclass(frozen=True)
class Outcome:
    decisions: DataFrame
    snapshots: DataFrame
    changes: DataFrame


def admit_prices(
    records: DataFrame, manifest: DataFrame, root: str, contract: contracts.Contract | None = None, previous: str = "last_run"
) -> Outcome:
    """Run announced price batches, one or many per source, through the gate and write what follows from them.

    ``records``: contract columns plus ``batch_id`` and ``position``. ``manifest``: batch_id, source_id,
    started_at, external_run_id, collector_error, one row per announced batch. Batches of a source count in the order of their start:
    each is judged and compared with the ones before it. ``previous``: ``last_run`` compares with what the newest comparable run of the
    source showed, so a gone identity is reported once; ``state`` with the newest row per identity over all runs, so it is reported by
    every later run. Everything is computed and checked before the first write. The run log is written last, so a job that dies
    before is repeated in full, and every earlier write skips what is stored.
    """
    gated = gate_batches(records, manifest, root, contract or contracts.price_contract())
    snapshots = snapshot_rows(gated.valid, gated.known).checkpoint()
    before, after = gated.states(root, "fact_price", snapshots, previous, STATE)
    events = diff.diff_prices(_numbers(before), _numbers(after), ["batch_id", *STATE], ["batch_id", *STATE[:2]])
    return gated.write(root, "fact_price", snapshots, change_rows(events, gated.decided))


@dataclass(frozen=True)
class Gated:
    """Announced batches after the gate: what is known of them, their records, the decisions, and the records let in."""

    known: DataFrame
    validated: DataFrame
    decided: DataFrame
    valid: DataFrame
    log: DataFrame

    def states(self, root: str, table: str, snapshots: DataFrame, previous: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(previous, current) rows of every admitted batch, see :func:`compared_states`."""
        spark, sources = snapshots.sparkSession, self.decided.filter(~F.col("refused")).select("source_id").distinct()
        if previous == "state":
            stored = latest(state.read_current(spark, root, table).join(sources, "source_id", "left_semi"), identity, state.ORDER)
        else:
            stored = last_shown(sinks.read_ledger(spark, root, table), self.log, sources)
        return compared_states(stored, snapshots, self.decided, previous, identity)

    def write(self, root: str, table: str, snapshots: DataFrame, changes: DataFrame, dimensions: Callable[[], None] | None = None) -> Outcome:
        """Check everything, then write it: facts, what ``dimensions`` writes, and the run log as the commit of all of them.

        A batch counts as finished when its run is logged. A job that dies before that is repeated in full: facts that are stored are
        skipped, and dimensions merge the same sightings once more.
        """
        # Conflicting events of one identity fail here, while nothing is written yet.
        changes = sinks.collapse_changes(changes).checkpoint()
        incidents = incident_rows(self.decided, sinks.read_incidents(snapshots.sparkSession, root, self.decided)).checkpoint()
        sinks.append_snapshots(snapshots, root, table)
        state.remember(snapshots, root, table)
        sinks.append_changes(changes, root)
        sinks.append_new(quarantine_rows(self.validated, self.decided).checkpoint(), root, "fact_quarantine", ["run_id", "position"])
        sinks.append_new(incidents, root, "fact_incident", ["incident_id", "status"])
        if dimensions is not None:
            dimensions()
        sinks.append_new(log_rows(self.decided), root, "fact_run", ["run_id"])
        return Outcome(self.decided, snapshots, changes)


def gate_batches(records: DataFrame, manifest: DataFrame, root: str, contract: contracts.Contract) -> Gated:
    """Drop replayed and finished batches, check the records of the rest, and decide about each batch."""
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    log = sinks.read_ledger(spark, root, "fact_run")
    finished = log.select(F.col("run_id").alias("batch_id"))
    announced = sinks.skip_replayed(manifest, log).join(finished, "batch_id", "left_anti")
    known = with_limits(announced.join(gate.current_baseline(log), "source_id", "left"), contract.limits)
    validated = contracts.validate(records.join(known.select("batch_id"), "batch_id", "left_semi"), contract)
    decided = decide_in_order(known, gate.batch_evidence(validated, contract)).checkpoint()
    return Gated(known, validated, decided, gate.admitted(contracts.first_valid(validated, contract), decided), log)


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in diff.PRICE_FIELDS.values()})


def change_rows(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Diff events under the columns of the change table."""
    runs = decided.select("batch_id", F.struct("batch_id", "started_at").alias("r"))
    joined = events.join(runs, "batch_id")

    def as_json(number: str, shown: str):
        return F.coalesce(F.col(number).cast("string"), F.when(F.col(shown).isNotNull(), F.concat(F.lit('"'), shown, F.lit('"'))))

    return joined.select(
        F.sha2(F.to_json(F.struct("r.batch_id", "entity_id", "change_type", "field_name", "mode", "tier")), 256).alias("event_id"),
        F.split("entity_id", ":")[0].alias("provider_id"), "source_id", F.col("r.batch_id").alias("run_id"), "entity_id", "change_type",
        "field_name", "mode", "tier", as_json("old_num", "old_text").alias("old_value"), as_json("new_num", "new_text").alias("new_value"),
        "prev_snapshot_id", "curr_snapshot_id", F.lit("pricing").alias("domain"), F.lit(None).cast("string").alias("summary"),
        F.col("r.started_at").alias("detected_at"),
    )


def field_changes(events: DataFrame, decided: DataFrame, domain: str, change_type: str) -> DataFrame:
    """Field changes (batch_id, source_id, entity_id, field_name, old_value, new_value) under the columns of the change table."""
    runs = decided.select("batch_id", "started_at")
    joined = events.join(runs, "batch_id").withColumn("change_type", F.lit(change_type))
    nothing = F.lit(None).cast("string")
    return joined.select(
        F.sha2(F.to_json(F.struct("batch_id", "entity_id", "change_type", "field_name")), 256).alias("event_id"),
        F.split("entity_id", ":")[0].alias("provider_id"), "source_id", F.col("batch_id").alias("run_id"), "entity_id", "change_type", "field_name",
        nothing.alias("mode"), nothing.alias("tier"), "old_value", "new_value", nothing.alias("prev_snapshot_id"), nothing.alias("curr_snapshot_id"),
        F.lit(domain).alias("domain"), nothing.alias("summary"), F.col("started_at").alias("detected_at"),
    )


def quarantine_rows(validated: DataFrame, decided: DataFrame) -> DataFrame:
    raw = F.to_json(F.struct(*[c for c in validated.columns if c not in ("issues", "schema_ok", "enum_fault")]))
    held = validated.withColumn("raw", raw).join(
        decided.filter("refused").select("batch_id", "source_id"), "batch_id")
    return held.select(
        F.concat(F.lit("incident-"), "batch_id").alias("incident_id"), "source_id", F.col("batch_id").alias("run_id"), "position", "raw", "issues")


def incident_rows(decided: DataFrame, stored: DataFrame) -> DataFrame:
    """New incidents, and those that an admitted batch resolves, stored ones included.

    A refused batch opens an incident; an admitted one resolves the newest that is open for its source. That is how brackets are
    matched: an incident at depth d is resolved by the next admitted batch that finds d incidents open. Depths come from running sums
    over one narrow row per batch, pairs from the neighbour at the same depth.
    """
    opened = gate.open_incidents(decided).join(
        decided.select(F.col("batch_id").alias("run_id"), F.col("started_at").alias("created_at"), F.col("lkg.run_id").alias("lkg_run_id"),
                       F.col("lkg.at").alias("lkg_at")), "run_id")
    opened = sinks.conform(opened, "fact_incident")
    sources = decided.select("source_id").distinct()
    waiting = stored.filter(F.col("status").isin(*gate.OPEN_STATES)).join(sources, "source_id", "left_semi")
    marks = (
        waiting.select("source_id", F.lit(0).alias("_late"), F.col("created_at").alias("_at"), F.col("run_id").alias("_run"), "incident_id", F.lit(1).alias("_step"))
        .unionByName(opened.select("source_id", F.lit(1).alias("_late"), F.col("created_at").alias("_at"), F.col("run_id").alias("_run"), "incident_id", F.lit(1).alias("_step")))
        .unionByName(decided.filter(~F.col("refused")).select(
            "source_id", F.lit(1).alias("_late"), F.col("started_at").alias("_at"), F.col("batch_id").alias("_run"), F.lit(None).cast("string").alias("incident_id"),
            F.lit(-1).alias("_step")))
    )
    along = Window.partitionBy("source_id").orderBy("_late", "_at", "_run")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    summed = marks.withColumn("_sum", F.sum("_step").over(upto))
    # An admitted batch that finds nothing open must not count: the lowest sum so far is the ground.
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))
    found_open = F.lag("_depth").over(along) > 0
    leveled = summed.withColumn("_depth", depth).withColumn("_hit", (F.col("_step") == 1) | F.coalesce(found_open, F.lit(False))).filter("_hit")
    level = F.when(F.col("_step") == 1, F.col("_depth")).otherwise(F.col("_depth") + 1)
    at_level = Window.partitionBy("source_id", "_level").orderBy("_late", "_at", "_run")
    matched = leveled.withColumn("_level", level).withColumn("_ends", F.lag("incident_id").over(at_level)).filter("_step = -1 and _ends is not null")
    ends = matched.select(F.col("_ends").alias("incident_id"), F.col("_at").alias("_resolved"))
    both = waiting.unionByName(opened).join(ends, "incident_id", "left")
    closed = F.col("_resolved").isNotNull()
    settled = both.withColumns({"status": F.when(closed, "resolved").otherwise(F.col("status")), "resolved_at": F.coalesce("_resolved", "resolved_at")})
    return sinks.conform(settled, "fact_incident")


def log_rows(decided: DataFrame) -> DataFrame:
    refused = F.col("refused")
    status = F.when(refused, "failed").when(F.col("records_invalid") > 0, "partial").otherwise("succeeded")
    return decided.select(
        F.col("batch_id").alias("run_id"), "source_id", status.alias("status"), "external_run_id", "started_at",
        F.col("started_at").alias("completed_at"), "records_seen",
        F.when(refused, 0).otherwise(F.col("records_valid")).cast("bigint").alias("records_accepted"),
        F.when(refused, F.col("records_seen")).otherwise(F.col("records_invalid")).alias("records_rejected"),
        F.when(refused, F.col("summary")).alias("error_message"),
    )
