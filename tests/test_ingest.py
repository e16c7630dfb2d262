"""Lifecycle and catalog batches from raw records to ledger and dimensions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from snapledger.plans.catalog import admit_catalog
from snapledger.plans.lifecycle import admit_lifecycle
from snapledger.schemas import RAW_CATALOG_DDL, RAW_SHUTDOWN_DDL
from snapledger.sources import sinks

MANIFEST = "batch_id string, source_id string, started_at timestamp, external_run_id string, collector_error string"


def manifest(spark, *rows):
    return spark.createDataFrame([(b, s, datetime(2024, 1, d), f"x-{b}", None) for b, s, d in rows], MANIFEST)


def shutdown(batch, position, name, when, replacement=None, gone=False):
    return (batch, position, name, "Group", "stable", "May 1, 2024", when, replacement, "https://d.example.com/p", gone)


def test_lifecycle_batches(spark, tmp_path):
    root = str(tmp_path)
    rows = [
        shutdown("r1", 0, "m-1.0", "No shutdown date announced"), shutdown("r1", 1, "m-2.0", "June 1, 2025"),
        shutdown("r2", 0, "m-1.0", "July 1, 2025", "m-2.0"), shutdown("r2", 1, "m-2.0", "June 1, 2025", gone=True),
    ]
    outcome = admit_lifecycle(spark.createDataFrame(rows, RAW_SHUTDOWN_DDL), manifest(spark, ("r1", "s", 1), ("r2", "s", 2)), root, "gemini")
    assert {r.batch_id: r.status for r in outcome.decisions.collect()} == {"r1": "healthy", "r2": "healthy"}
    changes = {(r.run_id, r.entity_id, r.field_name, r.old_value, r.new_value) for r in sinks.read_ledger(spark, root, "fact_change").collect()}
    assert {c for c in changes if c[2] == "lifecycleState"} == {("r2", "gemini:m-2.0", "lifecycleState", '"deprecated"', '"retired"'), ("r2", "gemini:m-1.0", "lifecycleState", None, '"deprecated"')}
    assert ("r2", "gemini:m-1.0", "recommendedReplacement", None, '"m-2.0"') in changes and {c[0] for c in changes} == {"r2"}
    entities = {r.entity_id: r for r in sinks.read_dimension(spark, root, "dim_entity").collect()}
    one, two = entities["gemini:m-1.0"], entities["gemini:m-2.0"]
    assert (one.lifecycle_state, one.retirement_not_before_date, one.is_active) == ("deprecated", date(2025, 7, 1), True)
    assert (two.lifecycle_state, two.is_active, two.first_seen_at) == ("retired", False, datetime(2024, 1, 1))
    # A later page that shows one row only leaves the other entity as it is.
    more = [shutdown("r3", 0, "m-1.0", "July 1, 2025", "m-2.0"), shutdown("r3", 1, "m-3.0", "No shutdown date announced")]
    admit_lifecycle(spark.createDataFrame(more, RAW_SHUTDOWN_DDL), manifest(spark, ("r3", "s", 3)), root, "gemini")
    after = {r.entity_id: r.lifecycle_state for r in sinks.read_dimension(spark, root, "dim_entity").collect()}
    assert after == {"gemini:m-1.0": "deprecated", "gemini:m-2.0": "retired", "gemini:m-3.0": None}
    assert sinks.read_ledger(spark, root, "fact_change").filter("run_id = 'r3'").count() == 0


def entry(batch, position, name, window, page="models", vision=None):
    return (batch, position, name, f"Name {name}", None, window, None, vision, None, ["Text"], ["Text"], ["Vision"] if vision is None else None, None,
            f"https://d.example.com/{page}")


def test_catalog_batches(spark, tmp_path):
    root = str(tmp_path)
    first = [entry("c1", 0, "gpt-5", "128,000"), entry("c1", 1, "gpt-4.1, gpt-4.1-mini", "1M tokens")]
    done = admit_catalog(spark.createDataFrame(first, RAW_CATALOG_DDL), manifest(spark, ("c1", "s", 1)), root, "openai")
    stored = {r.api_id: r for r in sinks.read_ledger(spark, root, "fact_capability").collect()}
    assert set(stored) == {"gpt-5", "gpt-4.1", "gpt-4.1-mini"} and done.conflicts.count() == done.unresolved.count() == 0
    assert (stored["gpt-5"].entity_id, stored["gpt-5"].context_window, stored["gpt-5"].supports_vision, stored["gpt-5"].family) == ("openai:gpt-5", 128000, True, "GPT-5")
    # Two batches at once; the id of the second reads differently but names the same entity.
    rows = [entry("c2", 0, "gpt-5", "256k"), entry("c2", 1, "gpt-4.1", "1M"), entry("c3", 0, "GPT-5", "400k"), entry("c3", 1, "gpt-4.1", "1M")]
    admit_catalog(spark.createDataFrame(rows, RAW_CATALOG_DDL), manifest(spark, ("c2", "s", 2), ("c3", "s", 3)), root, "openai")
    changes = [(r.run_id, r.entity_id, r.field_name, r.old_value, r.new_value) for r in sinks.read_ledger(spark, root, "fact_change").collect()]
    assert ("c2", "openai:gpt-5", "contextWindow", "128000", "256000") in changes
    names = {(r.entity_id, r.alias) for r in sinks.read_dimension(spark, root, "dim_alias").collect()}
    assert {("openai:gpt-5", "gpt-5"), ("openai:gpt-5", "GPT-5")} <= names
    entities = {r.entity_id: (r.name, r.first_seen_at.day, r.last_seen_at.day) for r in sinks.read_dimension(spark, root, "dim_entity").collect()}
    assert entities == {"openai:gpt-5": ("gpt-5", 1, 3), "openai:gpt-4.1": ("gpt-4.1", 1, 3), "openai:gpt-4.1-mini": ("gpt-4.1-mini", 1, 1)}


def test_catalog_conflicts_are_not_written(spark, tmp_path):
    root = str(tmp_path)
    rows = [entry("c1", 0, "gpt-5", "128k"), entry("c1", 1, "gpt-4.1, gpt-4.1-mini", "1M"), entry("c1", 2, "gpt-4.1-mini", "32k"), entry("c1", 3, "o3-mini", "200k")]
    done = admit_catalog(spark.createDataFrame(rows, RAW_CATALOG_DDL), manifest(spark, ("c1", "s", 1)), root, "openai")
    assert sorted(r.model_id for r in done.conflicts.collect()) == ["gpt-4.1-mini"] * 2
    assert {r.api_id for r in sinks.read_ledger(spark, root, "fact_capability").collect()} == {"gpt-5", "gpt-4.1", "o3-mini"}


FACTS = ("fact_lifecycle", "fact_capability", "fact_change", "fact_quarantine", "fact_run", "fact_incident")


def everything(spark, root):
    """All tables as they stand, as sorted texts."""
    facts = {n: sorted(map(str, sinks.read_ledger(spark, root, n).collect())) for n in FACTS}
    return facts | {n: sorted(map(str, sinks.read_dimension(spark, root, n).collect())) for n in ("dim_entity", "dim_alias")}


def ingests(spark):
    pages = [shutdown("r1", 0, "m-1.0", "No shutdown date announced"), shutdown("r1", 1, "m-2.0", "June 1, 2025"), shutdown("r2", 0, "m-1.0", "July 1, 2025")]
    entries = [entry("c1", 0, "gpt-5", "128k"), entry("c2", 0, "gpt-5", "256k"), entry("c2", 1, "o3-mini", "200k")]
    raw = spark.createDataFrame(pages, RAW_SHUTDOWN_DDL), spark.createDataFrame(entries, RAW_CATALOG_DDL)
    runs = manifest(spark, ("r1", "s", 1), ("r2", "s", 2)), manifest(spark, ("c1", "s", 1), ("c2", "s", 2))
    return {
        "lifecycle": (lambda root: admit_lifecycle(raw[0], runs[0], root, "gemini"), ("append_snapshots", "append_changes", "append_new", "write_dimension")),
        "catalog": (lambda root: admit_catalog(raw[1], runs[1], root, "openai"), ("append_snapshots", "append_changes", "append_new", "write_dimension")),
    }


@pytest.mark.parametrize("kind, at", [("lifecycle", 4), ("lifecycle", 5), ("catalog", 1), ("catalog", 5)])
def test_a_job_that_dies_after_a_write_is_repeated_in_full(spark, tmp_path, monkeypatch, kind, at):
    """Writes in order: snapshots, changes, quarantine, incidents, dimensions (one or two), run log. The job dies after write ``at``."""
    run, writes = ingests(spark)[kind]
    run(str(tmp_path / "whole"))
    want = everything(spark, str(tmp_path / "whole"))
    assert want["fact_run"] and want["dim_entity"]
    root, done = str(tmp_path / "dies"), []

    def failing(name, plain):
        def write(*args):
            plain(*args)
            done.append(name)
            if len(done) == at + 1:
                raise OSError(f"lost after {name}")

        return write

    with monkeypatch.context() as lost:
        for name in writes:
            lost.setattr(sinks, name, failing(name, getattr(sinks, name)))
        with pytest.raises(OSError, match="lost"):
            run(root)
    run(root)
    assert everything(spark, root) == want


def test_appends_read_only_what_they_can_meet(spark, tmp_path):
    root = str(tmp_path)
    schema = "run_id string, entity_id string, mode string, tier string, snapshot_id string, observed_at timestamp"
    for month in range(1, 7):
        rows = [(f"run-{month}", f"e{k}", "m", "t", f"s-{month}-{k}", datetime(2024, month, 3)) for k in range(5)]
        sinks.append_snapshots(spark.createDataFrame(rows, schema), root, "fact_price")
    again = spark.createDataFrame([("run-2", "e1", "m", "t", "s", datetime(2024, 2, 3)), ("run-2", "e9", "m", "t", "s", datetime(2024, 2, 3))], schema)
    dated = sinks.conform(again.withColumn("month", F.date_format("observed_at", "yyyy-MM")), "fact_price")
    near = sinks.stored_near(dated, root, "fact_price", "run_id", "month")
    files = {r.f for r in near.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("month=2024-02" in f for f in files)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan and "GreaterThanOrEqual(run_id,run-2)" in plan
    sinks.append_snapshots(again, root, "fact_price")
    stored = sinks.read_ledger(spark, root, "fact_price")
    assert stored.count() == 31 and stored.filter("run_id = 'run-2' and entity_id = 'e9'").count() == 1


def test_sources_are_registered_and_named_again(spark, tmp_path):
    root = str(tmp_path)
    ddl = "source_id string, provider_id string, kind string, label string, is_active boolean, slug string"
    sinks.register_sources(spark.createDataFrame([("s1", "p", "pricing", "old", None, "p-slug"), ("s2", "p", None, None, False, None)], ddl), root)
    sinks.register_sources(spark.createDataFrame([("s1", "p", None, "new", None, None), ("s3", "q", "catalog", None, None, None)], ddl), root)
    sources = {r.source_id: (r.kind, r.label, r.is_active) for r in sinks.read_dimension(spark, root, "dim_source").collect()}
    assert sources == {"s1": ("pricing", "new", True), "s2": (None, None, False), "s3": ("catalog", None, True)}
    assert {r.provider_id: r.slug for r in sinks.read_dimension(spark, root, "dim_provider").collect()} == {"p": "p-slug", "q": None}
