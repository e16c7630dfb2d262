"""Contracts, batch admission and the ledger writes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.operators import contracts, current, gate, temporal
from snapledger.plans import admission
from snapledger.schemas import RAW_PRICE_DDL
from snapledger.sources import sinks
from snapledger.sources.tables import explode_batches, load_raw, scan_changes

PRICE_DDL = ("batch_id string, position bigint, provider string, model_name string, pricing_mode string, context_tier string, input_price double,"
             " cached_input_price double, cache_write_price double, output_price double, pricing_unit string, source_url string")


def price(batch, position, name, **over):
    row = dict(batch_id=batch, position=position, provider="OpenAI", model_name=name, pricing_mode="standard", context_tier="default",
               input_price=1.0, cached_input_price=None, cache_write_price=None, output_price=2.0, pricing_unit="USD per 1M tokens",
               source_url="https://h.example.com/p")
    row.update(over)
    return tuple(row.values())


def prices(spark, *rows):
    return spark.createDataFrame(list(rows), PRICE_DDL)


MANIFEST_DDL = "batch_id string, source_id string, started_at timestamp, external_run_id string, collector_error string"


def manifest(spark, *rows):
    return spark.createDataFrame([(b, s, datetime(2024, 1, d), f"x-{b}", e) for b, s, d, e in rows], MANIFEST_DDL)


def judge(spark, rows, contract=None, baseline=None, error=None):
    contract = contract or contracts.price_contract("OpenAI")
    evidence = gate.batch_evidence(contracts.validate(rows, contract), contract)
    announced = admission.with_limits(manifest(spark, ("b", "s", 1, error)), contract.limits).withColumn(
        "baseline_count", F.lit(baseline).cast("bigint"))
    return gate.decide(announced, evidence).collect()[0]


def test_healthy_batch(spark):
    d = judge(spark, prices(spark, price("b", 0, "a"), price("b", 1, "c")))
    assert (d.status, d.records_valid, d.reason_codes, d.severity) == ("healthy", 2, [], "info")
    assert d.summary == "Evaluated 2 records: 100% valid. Source healthy."


def test_bad_mode_is_an_enum_fault(spark):
    d = judge(spark, prices(spark, price("b", 0, "a", pricing_mode="Standard!"), price("b", 1, "c")))
    assert d.status == "quarantined" and d.reason_codes == ["ILLEGAL_ENUM_VALUE", "SCHEMA_VALIDATION_FAILURE"]


def test_few_faults_only_degrade(spark):
    rows = [price("b", n, f"m{n}") for n in range(9)] + [price("b", 9, "m9", input_price=-1.0)]
    d = judge(spark, prices(spark, *rows))
    assert (d.status, d.records_invalid, d.refused) == ("degraded", 1, False)
    assert d.summary == "Evaluated 10 records: 9 valid, 1 rejected (10.0% error rate). Source degraded within tolerance."


def test_first_of_two_identities_wins(spark):
    rows = prices(spark, price("b", 5, "a", input_price=9.0), price("b", 2, "a", input_price=3.0), *[price("b", n + 10, f"m{n}") for n in range(8)])
    contract = contracts.price_contract()
    validated = contracts.validate(rows, contract)
    kept = {r.model_name: r.input_price for r in contracts.first_valid(validated, contract).collect()}
    assert kept["a"] == 3.0 and len(kept) == 9
    marked = {r.position: r.duplicate for r in contracts.mark_duplicates(validated, contract).collect()}
    assert [p for p, dup in marked.items() if dup] == [5]
    assert "DUPLICATE_IDENTIFIERS" in judge(spark, rows).reason_codes


def test_collapse_spike_and_tolerance(spark):
    three = prices(spark, *[price("b", n, f"m{n}") for n in range(3)])
    twelve = prices(spark, *[price("b", n, f"m{n}") for n in range(12)])
    collapsed = judge(spark, three, baseline=10)
    assert (collapsed.drift_type, collapsed.reason_codes, collapsed.severity) == ("collapse", ["RECORD_COUNT_COLLAPSE"], "critical")
    spiked = judge(spark, twelve, baseline=4)
    assert (spiked.drift_type, spiked.drift_percent, spiked.refused) == ("spike", 200.0, True)
    steady = judge(spark, twelve, baseline=11)
    assert steady.drift_type == "within_tolerance" and not steady.refused


def test_empty_and_crashed_batches_come_from_the_manifest(spark):
    none = prices(spark)
    empty = judge(spark, none)
    assert (empty.status, empty.reason_codes, empty.records_seen) == ("quarantined", ["ZERO_RECORDS"], 0)
    crashed = judge(spark, prices(spark, price("b", 0, "a")), error="timeout")
    assert crashed.reason_codes == ["COLLECTOR_EXECUTION_FAILURE"] and crashed.records_seen == 0
    assert crashed.summary == "Collector execution failed: timeout"


def test_deprecation_table_needs_an_active_record(spark):
    ddl = ("batch_id string, position bigint, api_model_name string, current_state string, deprecated_date string,"
           " tentative_retirement_date string, product_page_url string")
    url = "https://d.example.com"
    rows = spark.createDataFrame([
        ("b", 0, "claude-a", "Retired", "May 1, 2025", None, url), ("b", 1, "claude-b", "Legacy", None, "Not sooner than May 1, 2026", url)], ddl)
    d = judge(spark, rows, contracts.deprecation_contract())
    assert d.reason_codes == ["SEMANTIC_INVARIANT_VIOLATION"]
    bad = spark.createDataFrame([("b", 0, "claude-a", "INVALID", None, None, url), ("b", 1, "claude-b", "Active", None, "soon", url)], ddl)
    d = judge(spark, bad, contracts.deprecation_contract())
    assert d.records_invalid == 2 and "ILLEGAL_ENUM_VALUE" in d.reason_codes


def test_unknown_keys_and_localized_pages(spark):
    rows = spark.createDataFrame([
        ("b", 0, '{"model_id":"a"}', "a", "https://h/x"), ("b", 1, '{"model_id":"b","z":1}', "b", "https://h/x"), ("b", 2, '{"model_id":"c"}', "c", "https://h/x?hl=es")],
        "batch_id string, position bigint, raw string, model_id string, source_url string"
    ).withColumns({"display_name": F.lit(None).cast("string"), "capability_statement": F.lit(None).cast("string")})
    contract = contracts.catalog_contract(locale_parameter="hl", allowed_keys=("model_id",))
    found = {r.position: [i.message for i in r.issues] for r in contracts.validate(rows, contract).collect()}
    assert found == {0: [], 1: ["unknown key"], 2: ["localized rendering"]}


def test_hot_batch_counts(spark):
    """One batch and one identity hold most rows."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "other").otherwise("hot").alias("batch_id"), F.col("id").alias("position"), F.lit("OpenAI").alias("provider"),
        F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("m"), F.col("id"))).alias("model_name"),
        F.lit("standard").alias("pricing_mode"), F.lit("default").alias("context_tier"), F.lit(1.0).alias("input_price"),
        F.lit(None).cast("double").alias("cached_input_price"), F.lit(None).cast("double").alias("cache_write_price"), F.lit(1.0).alias("output_price"),
        F.lit("u").alias("pricing_unit"), F.lit("https://h.example.com").alias("source_url"))
    contract = contracts.price_contract()
    found = {r.batch_id: (r.records_seen, r.records_valid, r.duplicates) for r in gate.batch_evidence(contracts.validate(rows, contract), contract).collect()}
    assert found == {"hot": (2666, 1334, 1332), "other": (1334, 668, 666)}


# --- ledger ----------------------------------------------------------------------------------------------


def stored(spark, root, table):
    return sinks.read_ledger(spark, root, table)


def test_admission_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    first = prices(spark, *[price("r1", n, f"m{n}") for n in range(4)])
    run1 = manifest(spark, ("r1", "s", 1, None))
    admission.admit_prices(first, run1, root)
    assert stored(spark, root, "fact_price").count() == 4
    # A first run has nothing to differ from, so each entity is new.
    assert [r.change_type for r in stored(spark, root, "fact_change").collect()] == ["model_added"] * 4

    # The same run delivered again is a no-op.
    admission.admit_prices(first, run1, root)
    assert stored(spark, root, "fact_price").count() == 4 and stored(spark, root, "fact_run").count() == 1

    second = prices(spark, price("r2", 0, "m0", input_price=5.0), price("r2", 1, "m1"), price("r2", 2, "m2"), price("r2", 3, "m9"))
    admission.admit_prices(second, manifest(spark, ("r2", "s", 2, None)), root)
    changes = [(r.change_type, r.entity_id) for r in stored(spark, root, "fact_change").filter("run_id = 'r2'").collect()]
    assert sorted(changes) == [("model_added", "openai:m9"), ("model_removed", "openai:m3"), ("price_increased", "openai:m0")]

    # A collapsed batch and one without records write no price and no change, only evidence.
    third = prices(spark, price("r3", 0, "m0"))
    admission.admit_prices(third, manifest(spark, ("r3", "s", 3, None), ("r4", "s", 4, None)), root)
    assert stored(spark, root, "fact_price").count() == 8
    assert stored(spark, root, "fact_quarantine").count() == 1
    log = {r.run_id: r.status for r in stored(spark, root, "fact_run").collect()}
    assert log == {"r1": "succeeded", "r2": "succeeded", "r3": "failed", "r4": "failed"}
    assert {r.incident_id for r in stored(spark, root, "fact_incident").collect()} == {"incident-r3", "incident-r4"}

    # The next good run is compared with the last good one: the gone entity is not reported again.
    admission.admit_prices(prices(spark, price("r5", 0, "m0", input_price=5.0), price("r5", 1, "m1"), price("r5", 2, "m2"), price("r5", 3, "m9")),
                           manifest(spark, ("r5", "s", 5, None)), root)
    assert stored(spark, root, "fact_change").filter("run_id = 'r5'").count() == 0


def one_price(spark, *batches):
    return prices(spark, *[price(b, n, name, input_price=p) for b, p in batches for n, name in enumerate(("m0", "m1", "m2", "m3"))])


def test_several_batches_of_one_source_in_one_call(spark, tmp_path):
    root = str(tmp_path)
    admission.admit_prices(one_price(spark, ("r1", 1.0)), manifest(spark, ("r1", "s", 1, None)), root)
    runs = manifest(spark, ("r2", "s", 2, None), ("r3", "s", 3, None), ("r4", "s", 4, None), ("r5", "s", 5, None))
    rows = one_price(spark, ("r2", 2.0), ("r3", 3.0)).unionByName(prices(spark, *[price("r5", n, f"m{n}", input_price=3.0) for n in (0, 2, 3)]))
    admission.admit_prices(rows, runs, root, previous="last_run")
    changes = stored(spark, root, "fact_change").filter("run_id <> 'r1'").select("run_id", "entity_id", "change_type", "old_value", "new_value").collect()
    moved = [(r.run_id, r.entity_id, r.change_type, r.old_value, r.new_value) for r in changes if r.change_type != "model_removed"]
    assert sorted(moved) == sorted((run, f"openai:m{n}", "price_increased", old, new) for run, old, new in (("r2", "1.0", "2.0"), ("r3", "2.0", "3.0")) for n in range(4))
    assert [(r.run_id, r.entity_id) for r in changes if r.change_type == "model_removed"] == [("r5", "openai:m1")]
    log = {r.run_id: r.status for r in stored(spark, root, "fact_run").collect()}
    assert log == {"r1": "succeeded", "r2": "succeeded", "r3": "succeeded", "r4": "failed", "r5": "succeeded"}
    (incident,) = sinks.read_incidents(spark, root).collect()
    assert (incident.incident_id, incident.status, incident.resolved_at, incident.lkg_run_id, incident.lkg_at) == (
        "incident-r4", "resolved", datetime(2024, 1, 5), "r3", datetime(2024, 1, 3))


def test_one_external_run_twice_in_a_manifest(spark, tmp_path):
    root = str(tmp_path)
    twice = spark.createDataFrame(
        [("r0", "s", datetime(2024, 1, 1), "x", "timeout"), ("r1", "s", datetime(2024, 1, 2), "x", None), ("r2", "s", datetime(2024, 1, 3), "x", None)], MANIFEST_DDL)
    admission.admit_prices(one_price(spark, ("r1", 1.0), ("r2", 2.0)), twice, root)
    # The failed delivery does not block its retry; the second good one is a replay.
    assert {r.run_id: r.status for r in stored(spark, root, "fact_run").collect()} == {"r0": "failed", "r1": "succeeded"}
    assert {r.run_id for r in stored(spark, root, "fact_price").collect()} == {"r1"}


def test_a_good_batch_resolves_the_newest_open_incident(spark, tmp_path):
    root = str(tmp_path)
    admission.admit_prices(prices(spark), manifest(spark, ("a", "s", 1, None), ("b", "s", 2, None), ("c", "t", 2, None)), root)
    admission.admit_prices(one_price(spark, ("d", 1.0)), manifest(spark, ("d", "s", 3, None)), root)

    def states():
        return {r.incident_id[9:]: (r.status, r.resolved_at and r.resolved_at.day) for r in sinks.read_incidents(spark, root).collect()}

    assert states() == {"a": ("open", None), "b": ("resolved", 3), "c": ("open", None)}
    admission.admit_prices(one_price(spark, ("e", 1.0), ("f", 1.0), ("h", 1.0)), manifest(spark, ("e", "s", 4, None), ("f", "s", 5, None), ("g", "s", 6, None), ("h", "s", 7, None)), root)
    assert states() == {"a": ("resolved", 4), "b": ("resolved", 3), "c": ("open", None), "g": ("resolved", 7)}


def test_baselines_follow_the_decisions_of_earlier_batches(spark, tmp_path):
    root = str(tmp_path)
    sizes = {"r1": 30, "r2": 4, "r3": 28, "r4": 2}
    rows = prices(spark, *[price(b, n, f"m{n}") for b, k in sizes.items() for n in range(k)])
    runs = manifest(spark, *[(b, "s", d, None) for d, b in enumerate(sizes, 1)])
    found = {r.batch_id: (r.refused, r.baseline_count) for r in admission.admit_prices(rows, runs, root).decisions.collect()}
    assert found == {"r1": (False, None), "r2": (True, 30), "r3": (False, 30), "r4": (True, 28)}


def test_ledger_reads_use_the_stored_folders(spark, tmp_path):
    root = str(tmp_path)
    admission.admit_prices(one_price(spark, ("r1", 1.0)), manifest(spark, ("r1", "s", 1, None)), root)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    changes, snapshots = stored(spark, root, "fact_change"), stored(spark, root, "fact_price")
    for read in (scan_changes(changes, since="2024-01-01", order=[F.col("event_id")]), temporal.in_window(changes, "2024-01-01", "2024-02-01")):
        assert "PartitionFilters: [isnotnull(day" in plan(read) and read.count() == 4
    assert "PartitionFilters: [isnotnull(month" in plan(current.as_of(snapshots, ["entity_id"], ["observed_at"], "2024-02-01"))
    assert "PartitionFilters: [isnotnull(month" in plan(current.as_of_pairs(snapshots, ["entity_id"], ["observed_at"], "2024-01-15", "2024-02-01"))


def test_repeated_job_after_a_crash_adds_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows, run = prices(spark, *[price("r1", n, f"m{n}") for n in range(3)]), manifest(spark, ("r1", "s", 1, None))
    outcome = admission.admit_prices(rows, run, root)
    # The log was written last; without it the job runs in full again.
    sinks.append_snapshots(outcome.snapshots, root, "fact_price")
    sinks.append_changes(outcome.changes, root)
    assert stored(spark, root, "fact_price").count() == 3 and stored(spark, root, "fact_change").count() == 3


CHANGE_DDL = "run_id string, entity_id string, change_type string, field_name string, mode string, tier string, new_value string"


def test_conflicting_changes_fail(spark):
    same = [("r", "e", "t", None, None, None, "1")] * 2
    assert sinks.collapse_changes(spark.createDataFrame(same, CHANGE_DDL)).count() == 1
    clash = [same[0], ("r", "e", "t", None, None, None, "2")]
    with pytest.raises(Exception, match="conflicting change events"):
        sinks.collapse_changes(spark.createDataFrame(clash, CHANGE_DDL)).collect()


def test_raw_json_keeps_malformed_records(spark, tmp_path):
    good = {"batch_id": "b", "position": 0, "provider": "OpenAI", "input_price_per_1m_tokens": 1.5}
    (tmp_path / "raw.json").write_text(json.dumps(good) + "\n{broken\n")
    rows = load_raw(spark, str(tmp_path / "raw.json"), RAW_PRICE_DDL).cache()
    assert rows.count() == 2 and rows.filter("corrupt_record is not null").count() == 1
    named = admission.contract_records(rows.drop("corrupt_record"), "https://default.example.com")
    assert {r.source_url for r in named.collect()} == {"https://default.example.com"}


def test_batches_stored_as_one_array(spark):
    batches = spark.createDataFrame([("b", '[{"a": 1}, {"a": "x"}, 7]')], "batch_id string, payload string")
    rows = explode_batches(batches, "payload", "a STRING", ["batch_id"]).orderBy("position").collect()
    assert [(r.position, r.record.a if r.record else None) for r in rows] == [(0, "1"), (1, "x"), (2, None)]


def test_health_transitions(spark):
    rows = spark.createDataFrame(
        [("s", datetime(2024, 1, d), d, state) for d, state in enumerate(["healthy", "healing", "recovered", "quarantined", "degraded"], 1)],
        "source_id string, at timestamp, run_id int, state string")
    found = [(r.before, r.state) for r in gate.illegal_transitions(rows, F.to_date("at")).orderBy("run_id").collect()]
    assert found == [("healthy", "healing"), ("quarantined", "degraded")]
