"""Streams over several files must end where the batch twin ends."""

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from snapledger.operators import diff
from snapledger.plans.admission import admit_prices, contract_records
from snapledger.schemas import RAW_PRICE_DDL
from snapledger.sources import sinks
from snapledger.streaming import changes, jobs, landing

PRICE = (
    "entity_id string, mode string, tier string, snapshot_id string, input double, cached double, cache_write double, output double,"
    " pricing_unit string, source_url string, observed_at timestamp, run_id int")
IDENTITY, ORDER = ["entity_id", "mode", "tier"], ["observed_at", "run_id"]


def observation(run, entity, value, day):
    return (entity, "m", "t", f"{entity}-{run}", value, None, None, 1.0, "u", "s", datetime(2024, 1, day), run)


def moves(df):
    return sorted((r.entity_id, r.prev_snapshot_id, r.curr_snapshot_id, r.change_type) for r in df.collect())


def deliver(spark, folder, rows, schema=PRICE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_live_changes_equal_the_history_diff(spark, tmp_path):
    batches = [
        [observation(1, "a", 1.0, 1), observation(1, "b", 1.0, 1)],
        [observation(3, "a", 2.0, 3), observation(2, "a", 2.0, 2)],
        [observation(4, "a", 1.0, 4), observation(4, "b", 3.0, 4), observation(4, "c", 1.0, 4)],
    ]
    for rows in batches:
        deliver(spark, tmp_path / "in", rows)
    stream = jobs.read_files(spark, str(tmp_path / "in"), PRICE, files_per_batch=1)
    query = changes.change_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), IDENTITY, ORDER)
    states = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    # Only touched identities are written, and the state has one row per identity.
    assert [s.numRowsUpdated for s in states] == [2, 1, 3]
    assert states[-1].numRowsTotal == 3
    assert any(name.startswith("rocksdb") for name in states[-1].customMetrics)
    whole = spark.createDataFrame([r for rows in batches for r in rows], PRICE)
    assert moves(spark.read.parquet(str(tmp_path / "out"))) == moves(diff.price_history_changes(whole, IDENTITY, ORDER, F.to_date("observed_at")))


def test_states_survive_a_restart_and_late_rows_change_nothing(spark, tmp_path):
    for rows in ([observation(5, "a", 1.0, 10)], [observation(2, "a", 9.0, 3), observation(6, "a", 2.0, 11)], [observation(1, "a", 7.0, 2)]):
        deliver(spark, tmp_path / "in", rows)
        stream = jobs.read_files(spark, str(tmp_path / "in"), PRICE)
        changes.change_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), IDENTITY, ORDER)
    assert moves(spark.read.parquet(str(tmp_path / "out"))) == [("a", "a-5", "a-6", "price_increased")]


def test_many_identities_take_one_step_a_group(spark, tmp_path):
    # A null identity, equal and late rows, and identities that only some deliveries hold, all in four groups.
    names = [None, *(f"e{k}" for k in range(60))]
    batches = [[observation(run, e, float((run * 7 + k) % 5), run) for k, e in enumerate(names) if (k + run) % 3] for run in (1, 2, 4, 5)]
    batches[2] += [observation(3, e, 9.5, 3) for e in names[::2]]
    late = [observation(1, e, 8.0, 1) for e in names[1::4]] + [observation(4, e, 7.0, 4) for e in names[1::5]]
    for rows in (*batches[:3], batches[3], late):
        deliver(spark, tmp_path / "in", rows)
    stream = jobs.read_files(spark, str(tmp_path / "in"), PRICE, files_per_batch=1)
    for name, value in changes.STATE_STORE.items():
        spark.conf.set(name, value)
    events = changes.live_changes(stream, IDENTITY, ORDER, groups=4)
    query = events.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) == 4
    # Every late row is at or before the newest of its identity, so the stream ends as without them.
    whole = spark.createDataFrame([r for rows in batches for r in rows], PRICE)
    wanted = diff.price_history_changes(whole, IDENTITY, ORDER, F.to_date("observed_at"))

    def texts(df):
        return sorted(map(str, df.filter("entity_id is not null").select("entity_id", "prev_snapshot_id", "curr_snapshot_id", "change_type", "old_num", "new_num").collect()))

    found = spark.read.parquet(str(tmp_path / "out"))
    assert texts(found) == texts(wanted)
    assert found.filter("entity_id is null").count() == 4  # five rows; the twin joins and leaves null identities out


def test_values_of_every_kind_pass_the_state_unchanged(spark, tmp_path):
    """Against the table: missing and NaN numbers, whole numbers that a double cannot hold, missing key parts beside empty ones."""
    schema = ("entity_id long, mode string, tier date, input double, cached decimal(20,2), cache_write float, output long, observed_at timestamp,"
              " run_id decimal(12,1), flag boolean, tags array<string>")
    big, nan = (1 << 60) + 1, float("nan")
    values = [(1.5, Decimal("9.00"), 0.1, big, True, ["a", None]), (None, None, None, None, None, None), (nan, Decimal("10.50"), nan, big + 1, False, []),
              (nan, Decimal("10.50"), 0.25, 0, True, ["b"]), (0.0, Decimal("0.00"), 0.0, big, None, None)]
    keys = [(e, m, t) for e in (big, big + 1, 0, None) for m in ("x", "", None) for t in (date(2024, 1, 1), date(1970, 1, 1), None)]
    at = datetime(2024, 1, 1, 0, 0, 0, 123456)
    batches = [[(*key, *values[(run + n) % 5][:4], at, Decimal(run), *values[(run + n) % 5][4:]) for n, key in enumerate(keys)] for run in (2, 9, 10, 100)]

    def derived(of):
        # Says what the stored columns hold, to the last digit.
        texts = [F.coalesce(F.to_json(F.struct(of(c).alias("v"))), F.lit("-")) for c in ("run_id", "output", "cached", "cache_write", "input", "flag", "tags", "entity_id")]
        return {"snapshot_id": F.concat_ws(" ", *texts), "pricing_unit": of("flag").cast("string"), "source_url": of("tags").cast("string")}

    for rows in batches:
        deliver(spark, tmp_path / "in", rows, schema)
    stream = jobs.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    for name, value in changes.STATE_STORE.items():
        spark.conf.set(name, value)
    events = changes.live_changes(stream, IDENTITY, ORDER, 3, derived)
    plan = events._jdf.queryExecution().analyzed().toString()
    moved = plan[plan.index("FlatMapGroupsInPandasWithState"):]
    assert moved.count("to_json") == 1 and "to_json" in moved and "snapshot_id" not in moved  # only the array is a text
    events.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    whole = spark.createDataFrame([r for rows in batches for r in rows], schema)
    wanted = diff.price_history_changes(whole, IDENTITY, ORDER, derived=derived)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.columns == wanted.columns and found.count() > 300
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


LANDED = f"{landing.ENVELOPE_DDL}, {RAW_PRICE_DDL.replace('batch_id STRING, ', '')}"


def record(batch, position, model, price, day=1, start=1):
    return (batch, "s", datetime(2024, 1, start), f"x-{batch}", datetime(2024, 1, day), None, position, "gemini", model, "standard", "all", price, None, None, 2.0,
            "USD per 1M tokens", "https://p.example.com/a")


def mark(batch, expected, day=1, start=1):
    return (batch, "s", datetime(2024, 1, start), f"x-{batch}", datetime(2024, 1, day), expected, *[None] * 11)


def ledger(spark, root):
    """Every ledger table as sorted texts."""
    names = ("fact_price", "fact_change", "fact_quarantine", "fact_run", "fact_incident")
    return {n: sorted(map(str, sinks.read_ledger(spark, root, n).collect())) for n in names}


def test_a_batch_in_pieces_equals_its_batch_twin(spark, tmp_path):
    one = [record("b1", k, f"model-{k}", 1.0 + k) for k in range(6)]
    two = [record("b2", k, f"model-{k}", 2.0 + k, 2, 2) for k in range(6)] + [record("b2", 6, "bad model!", -1.0, 2, 2)]
    # The mark of b1 comes before its last records; b2 begins before b1 ends; one delivery is empty.
    deliveries = [[*one[:2], mark("b1", 6)], [*one[2:4], *two[:3]], [*one[4:]], [*two[3:], mark("b2", 7, 2, 2)]]
    seen = []
    for rows in deliveries:
        deliver(spark, tmp_path / "in", rows, LANDED)
        stream = jobs.read_files(spark, str(tmp_path / "in"), LANDED)
        landing.price_landing(stream, str(tmp_path / "live"), str(tmp_path / "cp"), "https://p.example.com/a")
        seen.append(sorted(r.run_id for r in sinks.read_ledger(spark, str(tmp_path / "live/ledger"), "fact_run").collect()))
    assert seen == [[], [], ["b1"], ["b1", "b2"]]
    raw = spark.createDataFrame([*one, *two], LANDED).drop(*[c for c in landing.ENVELOPE if c != "batch_id"])
    manifest = spark.createDataFrame(
        [(b, "s", datetime(2024, 1, d), f"x-{b}", None) for b, d in (("b1", 1), ("b2", 2))],
        "batch_id string, source_id string, started_at timestamp, external_run_id string, collector_error string")
    admit_prices(contract_records(raw, "https://p.example.com/a"), manifest, str(tmp_path / "twin"))
    assert ledger(spark, str(tmp_path / "live/ledger")) == ledger(spark, str(tmp_path / "twin"))
    # What waits at the end is nothing.
    last = spark.read.parquet(str(tmp_path / "live/landing/waiting"))
    assert last.filter("micro = 3").count() == 0


def test_a_batch_that_never_ends_is_refused_in_time(spark, tmp_path):
    deliver(spark, tmp_path / "in", [record("b1", 0, "model-a", 1.0), record("b2", 0, "model-a", 1.0), mark("b2", 2)], LANDED)
    deliver(spark, tmp_path / "in", [record("b3", 0, "model-a", 1.0, 2, 2), mark("b3", 1, 2, 2)], LANDED)
    deliver(spark, tmp_path / "in", [record("b4", 0, "model-a", 1.0, 9, 9), mark("b4", 1, 9, 9)], LANDED)
    stream = jobs.read_files(spark, str(tmp_path / "in"), LANDED, files_per_batch=1)
    landing.price_landing(stream, str(tmp_path / "live"), str(tmp_path / "cp"), "https://p.example.com/a", "3 days")
    root = str(tmp_path / "live/ledger")
    runs = {r.run_id: (r.status, r.error_message) for r in sinks.read_ledger(spark, root, "fact_run").collect()}
    assert {b: s for b, (s, _) in runs.items()} == {"b1": "failed", "b2": "failed", "b3": "succeeded", "b4": "succeeded"}
    assert {r.run_id for r in sinks.read_ledger(spark, root, "fact_price").collect()} == {"b3", "b4"}
    assert {r.run_id for r in sinks.read_ledger(spark, root, "fact_quarantine").collect()} == {"b1", "b2"}


def test_a_repeated_micro_batch_replaces_its_own_output(spark, tmp_path):
    judged = []

    def judge(records, due, micro):
        judged.append((micro, sorted((r.batch_id, r.received, r.whole) for r in due.collect()), records.count()))

    first = spark.createDataFrame([record("b1", 0, "m", 1.0), mark("b1", 2)], LANDED)
    second = spark.createDataFrame([record("b1", 1, "n", 1.0)], LANDED)
    for micro, rows in ((0, first), (1, second), (1, second), (2, first.limit(0))):
        landing.land(rows, micro, str(tmp_path), judge, "1 day")
    assert judged == [(1, [("b1", 2, True)], 2)] * 2


def test_external_runs_are_processed_once(spark, tmp_path):
    schema = "run_id string, source_id string, external_run_id string, started_at timestamp, status string"
    start = datetime(2024, 1, 1)
    for day in range(3):
        at = start + timedelta(days=day)
        # x1 comes three times; z fails at first, so its retry must pass, and is a repeat only after that.
        rows = [(f"a{day}", "s", "x1", at, "succeeded"), (f"b{day}", "s", f"y{day}", at, "partial"), (f"c{day}", "s", "z", at, "failed" if day == 0 else "succeeded")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = jobs.first_delivery(jobs.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1))
    writer = kept.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    writer.format("parquet").start(str(tmp_path / "out")).awaitTermination()
    found = sorted((r.external_run_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("x1", "succeeded"), ("y0", "partial"), ("y1", "partial"), ("y2", "partial"), ("z", "failed"), ("z", "succeeded")]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    schema = "detected_at timestamp, provider string, category string"
    for days in ([1, 1, 2], [8], [8], [2, 8, 9]):  # the second day is long past when it comes again
        rows = [(datetime(2024, 1, d, 5), "p", "c") for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = jobs.daily_counts(jobs.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1), "1 day")
    jobs.write_updates(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {r.day.day: r.events for r in jobs.newest_rows(spark, str(tmp_path / "out"), ["day", "provider", "category"]).collect()}
    assert found == {1: 2, 2: 1, 8: 3, 9: 1}


def test_silent_sources_are_judged_without_new_rows(spark, tmp_path):
    schema = "source_id string, status string, started_at timestamp"
    rows = [("quiet", "succeeded", datetime(2024, 1, 1)), ("busy", "succeeded", datetime(2024, 1, 9)), ("failing", "failed", datetime(2024, 1, 9))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.starts_stream(jobs.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))

    def judged(at):
        rows = jobs.silent_now(spark, str(tmp_path / "out"), F.lit(at).cast("timestamp"), F.lit(2880), F.lit(2880)).collect()
        return {r.source_id: (r.freshness, r.overdue) for r in rows}

    assert judged("2024-01-10") == {"quiet": ("stale", True), "busy": ("fresh", False), "failing": ("unknown", False)}
    # Nothing arrives any more: the next look reports all of them.
    assert judged("2024-02-10") == {"quiet": ("stale", True), "busy": ("stale", True), "failing": ("unknown", True)}
