"""Stored current state against the newest rows of the whole ledger."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.operators.current import latest_comparable
from snapledger.plans import admission
from snapledger.sources import sinks, state
from tests.test_gate import manifest, price, prices

TABLE = "fact_price"


def ranked(spark, root):
    rows = latest_comparable(sinks.read_ledger(spark, root, TABLE), sinks.read_ledger(spark, root, "fact_run"), state.IDENTITY[TABLE], state.ORDER)
    return sorted(r["snapshot_id"] for r in rows.collect())


def held(spark, root, **keys):
    return sorted(r["snapshot_id"] for r in state.read_current(spark, root, TABLE, **keys).collect())


NAMES = ("m0", "m1", "m2", "m3")


def store(spark, root, batch, number, value, names=NAMES, source="s"):
    """What an ingest writes before its run is logged."""
    rows = spark.createDataFrame([(batch, source, f"openai:{n}", "standard", "default", datetime(2024, 1, number), f"{batch}/openai:{n}/x", value) for n in names],
                                 "run_id string, source_id string, entity_id string, mode string, tier string, observed_at timestamp, snapshot_id string, input double")
    rows = rows.withColumn("created_at", F.col("observed_at"))
    sinks.append_snapshots(rows, root, TABLE)
    state.remember(rows, root, TABLE)


def log(spark, root, batch, number, source="s"):
    runs = spark.createDataFrame([(batch, source, "succeeded", datetime(2024, 1, number))], "run_id string, source_id string, status string, started_at timestamp")
    sinks.append_new(runs, root, "fact_run", ["run_id"])


def ingest(spark, root, batch, number, value, names=NAMES, source="s"):
    store(spark, root, batch, number, value, names, source)
    log(spark, root, batch, number, source)


def admit(spark, root, batch, number, value, names):
    rows = prices(spark, *[price(batch, n, name, input_price=value) for n, name in enumerate(names)])
    return admission.admit_prices(rows, manifest(spark, (batch, "s", number, None)), root, previous="state")


def test_state_equals_the_ranked_ledger_at_every_step(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == []
    ingest(spark, root, "r1", 1, 1.0)
    assert state.version(spark, root, TABLE) == 0 and held(spark, root) == ranked(spark, root) and len(held(spark, root)) == 4
    assert state.compact(spark, root, TABLE) == 1 and held(spark, root) == ranked(spark, root)
    ingest(spark, root, "r2", 2, 2.0, ("m0", "m1", "m2", "m7"))
    ingest(spark, root, "q1", 2, 9.0, source="t")
    assert held(spark, root) == ranked(spark, root) and len(held(spark, root)) == 9
    assert state.compact(spark, root, TABLE) == 2 and held(spark, root) == ranked(spark, root)
    # The delta of r2 names base 1 and is read once more beside base 2; nothing changes by it.
    assert state.compact(spark, root, TABLE) == 3 and held(spark, root) == ranked(spark, root)


def test_ingests_compare_with_the_state_and_keep_it(spark, tmp_path):
    root = str(tmp_path)
    admit(spark, root, "r1", 1, 1.0, ("m0", "m1"))
    state.compact(spark, root, TABLE)
    admit(spark, root, "r2", 2, 2.0, ("m0", "m4"))
    admit(spark, root, "r3", 3, 2.0, ("m0", "m1"))
    assert held(spark, root) == ranked(spark, root) and len(held(spark, root)) == 3
    changes = sinks.read_ledger(spark, root, "fact_change").filter("run_id <> 'r1' and change_type <> 'model_removed'").collect()
    assert sorted((c.run_id, c.entity_id, c.change_type) for c in changes) == [
        ("r2", "openai:m0", "price_increased"), ("r2", "openai:m4", "model_added"), ("r3", "openai:m1", "price_increased")]


@pytest.mark.parametrize("compactions", [0, 1, 2])
def test_rows_of_a_lost_job_count_only_once_its_run_is_logged(spark, tmp_path, compactions):
    root = str(tmp_path)
    ingest(spark, root, "r1", 1, 1.0)
    state.compact(spark, root, TABLE)
    before = held(spark, root)
    store(spark, root, "r2", 2, 2.0)  # the job dies here
    for _ in range(compactions):
        state.compact(spark, root, TABLE)
    assert held(spark, root) == before == ranked(spark, root)
    ingest(spark, root, "r2", 2, 2.0)
    assert held(spark, root) == ranked(spark, root) != before


def test_a_delta_written_during_a_compaction_is_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ingest(spark, root, "r1", 1, 1.0)
    state.compact(spark, root, TABLE)
    dealt, inside = state._dealt, []

    def between(rows):
        # After the compaction has read its rows and before its base is written another ingest ends.
        if not inside:
            inside.append(True)
            ingest(spark, root, "r2", 2, 2.0)
        return dealt(rows)

    with monkeypatch.context() as slow:
        slow.setattr(state, "_dealt", between)
        assert state.compact(spark, root, TABLE) == 2
    assert held(spark, root) == ranked(spark, root) and {s.split("/")[0] for s in held(spark, root)} == {"r2"}
    state.compact(spark, root, TABLE)
    assert held(spark, root) == ranked(spark, root)


def test_a_half_written_base_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    ingest(spark, root, "r1", 1, 1.0)
    state.compact(spark, root, TABLE)
    ingest(spark, root, "r2", 2, 2.0)
    want = held(spark, root)
    # A lost compaction has left a folder and no commit.
    sinks.conform(sinks.read_ledger(spark, root, TABLE).limit(1), TABLE).drop("month").withColumns({"pending": F.lit(False), "bucket": F.lit(0)}) \
        .write.partitionBy("bucket").parquet(f"{root}/current/{TABLE}/base/version=2")
    assert held(spark, root) == want and state.compact(spark, root, TABLE) == 2 and held(spark, root) == want


def test_entities_are_read_from_and_written_to_their_folders_only(spark, tmp_path):
    root = str(tmp_path)
    for number in range(1, 4):
        ingest(spark, root, f"r{number}", number, float(number))
    state.compact(spark, root, TABLE)
    ingest(spark, root, "q1", 4, 1.0, ("m0",), source="t")
    wanted = ["openai:m0", "openai:none"]
    assert {p.name for p in (tmp_path / "current" / TABLE / "delta" / "after=1").iterdir()} == {
        f"bucket={spark.range(1).select(state.bucket(F.lit('openai:m0'))).first()[0]}"}
    assert held(spark, root, entity_ids=wanted) == [s for s in ranked(spark, root) if "openai:m0/" in s]
    plan = state.read_current(spark, root, TABLE, wanted)._jdf.queryExecution().executedPlan().toString()
    # Every scan of the state is cut to the folders of the wanted entities, and the history is not read.
    scans = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)", plan) if "version#" in f or "after#" in f]
    assert len(scans) == 3 and all("bucket#" in f for f in scans) and "month#" not in plan


def test_rows_are_dealt_once_and_a_compaction_stores_nothing_in_between(spark, tmp_path, monkeypatch):
    """Of rows that repeat an identity within a run the newest is kept; what waits for its run stays per run."""
    root, plans, whole = str(tmp_path), [], state.latest

    def seen(rows, keys, order):
        plans.append(whole(rows, keys, order))
        return plans[-1]

    def never(*_):
        raise AssertionError("a second shuffle or a checkpoint of whole rows")

    log(spark, root, "r1", 1)
    schema = "run_id string, source_id string, entity_id string, mode string, tier string, observed_at timestamp, snapshot_id string, created_at timestamp"
    rows = [(run, "s", f"e{n % 3}", "m", None, datetime(2024, 1, 1 + n), f"{run}/{n}", datetime(2024, 1, 1)) for run in ("r1", "r2", "r3", None) for n in range(7)]
    with monkeypatch.context() as patched:
        patched.setattr(state, "latest", seen)
        patched.setattr(state, "_dealt", never)
        state.remember(spark.createDataFrame(rows, schema), root, TABLE)
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    kept = {f"{run}/{n}" for run in ("r1", "r2", "r3", None) for n in (4, 5, 6)}
    delta = spark.read.parquet(f"{root}/current/{TABLE}/delta")
    assert sorted(r["snapshot_id"] for r in delta.collect()) == sorted(kept)
    assert delta.filter(F.col("bucket") != state.bucket(F.col("entity_id"))).isEmpty()
    sinks.append_snapshots(spark.createDataFrame(rows, schema), root, TABLE)
    with monkeypatch.context() as patched:
        patched.setattr(type(delta), "checkpoint", never)
        assert state.compact(spark, root, TABLE) == 1
    base = spark.read.parquet(f"{root}/current/{TABLE}/base")
    assert sorted(r["run_id"] for r in base.filter("not pending").collect()) == ["r1"] * 3
    waiting = sorted(str(r["run_id"]) for r in base.filter("pending").collect())
    assert waiting == ["None"] * 3 + ["r2"] * 3 + ["r3"] * 3
    log(spark, root, "r3", 2)
    assert held(spark, root) == ["r3/4", "r3/5", "r3/6"]
