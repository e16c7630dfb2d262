"""What keeps the larger jobs small: columns that are not used do not travel, and tasks read bounded parts."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import lineage, text
from snapledger.operators import contracts, current, diff
from snapledger.operators.ordered import latest
from snapledger.plans import explore
from snapledger.queries import REGISTRY, admission, reads
from snapledger.queries.history import KEY, ORDER
from snapledger.schemas import table_schema
from snapledger.session import SPLIT, SPLIT_BYTES, tune
from snapledger.sources import sinks, tables, views

SF = "/root/testdata/sf0.001"


def test_the_tier_pick_reads_only_used_columns(spark, tmp_path):
    rows = [(e, m, t, at, float(at), f"wide {at}") for e in (1, 2, None) for m in ("n", "a", None) for t in ("x", "f", None) for at in (1, 2)]
    spark.createDataFrame(rows, "entity_id long, mode string, tier string, at long, input double, wide string").write.parquet(str(tmp_path / "p"))
    newest = latest(spark.read.parquet(str(tmp_path / "p")), ["entity_id", "mode", "tier"], ["at"])
    picked = current.primary_tier(newest, ["entity_id"], "n", ["f", "x"])
    assert sorted(map(str, picked.collect())) == sorted(
        f"Row(entity_id={e}, mode='n', tier='f', at=2, input=2.0, wide='wide 2')" for e in (1, 2, None))
    plan = picked.select("entity_id", "input")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: \S*input", plan) and not re.search(r"ReadSchema: \S*wide", plan)


def test_the_newest_primary_price_is_picked_in_one_shuffle(spark):
    """The same rows as the tier pick of the newest rows, missing names and odd tiers included, with one exchange."""
    names = [None, "n", "a", "x", "Long", "long context", " F ", "> 200k"]
    rows = [(e, m, t, at, (at or 7) % 3, f"{e} {m} {t} {at}") for e in (1, 2, 3, None) for m in names[:3] for t in names for at in (1, 2, 4, None)
            if not (e == 2 and m == "n") and not (e == 3 and (m == "n" or t in ("x", " F ")))]
    df = spark.createDataFrame(rows, "entity_id long, mode string, tier string, at long, run long, snapshot_id string")
    for mode, tiers in (("n", ("f", "x")), ("standard", current.STANDARD_TIERS)):
        want = current.primary_tier(latest(df, ["entity_id", "mode", "tier"], ["at", "run"]), ["entity_id"], mode, tiers)
        got = current.newest_primary(df, ["at", "run"], ["entity_id"], mode, tiers)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.columns == df.columns and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_entries_shuffle_prices_once(spark):
    prices = spark.createDataFrame([], "entity_id long, mode string, tier string, snapshot_id string, input double, cached double, output double,"
                                   " currency string, pricing_unit string, source_url string, observed_at timestamp, run_id long")
    capabilities = spark.createDataFrame([], "entity_id long, api_id string, display_name string, family string, stage string, context_window long,"
                                         " max_output_tokens long, supports_vision boolean, supports_tool_calling boolean, input_modalities array<string>,"
                                         " output_modalities array<string>, statement string, observed_at timestamp")
    lifecycle = spark.createDataFrame([], "entity_id long, state string, deprecated_on date, retirement_date date, not_before_date date,"
                                      " replacement string, observed_at timestamp, run_id long")
    entities = spark.createDataFrame([(1, "p", "m")], "entity_id long, provider string, model_name string")
    found = explore.current_entries(entities, prices, capabilities, lifecycle, F.lit("2024-01-01").cast("timestamp"), ["observed_at", "run_id"],
                                    ["observed_at", "run_id"])
    plan = found.select("entity_id", "price_snapshot_id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[row_number", plan)) == 2  # prices and lifecycle
    assert [tuple(r) for r in found.select("entity_id", "price_mode").collect()] == [(1, None)]


def test_entries_sort_prices_without_the_texts_that_derive_from_them(spark):
    plan = reads.entries(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    picks = [m.start() for m in re.finditer(r"Window \[row_number", plan)]  # prices, lifecycle; a plan lists what it reads last
    for derived in ("https://prices.example.com/s", "USD per 1M tokens", "EUR"):
        assert 0 <= plan.find(derived) and plan.rfind(derived) < picks[0]


def _up_to_the_shuffle(plan: str, column: str) -> list[str]:
    """The nodes above the one scan that reads ``column``, up to the first exchange."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[ :+\-]*", line).group()) for line in lines]
    scans = [n for n, line in enumerate(lines) if "FileScan" in line and re.search(rf"ReadSchema: \S*{column}|\[[^\]]*{column}#", line)]
    assert len(scans) == 1
    found, at = [], depth[scans[0]]
    for n in range(scans[0] - 1, -1, -1):
        if depth[n] < at:
            found, at = [*found, lines[n].lstrip(" :+-")], depth[n]
            if found[-1].startswith("Exchange"):
                return found
    raise AssertionError("no exchange above the scan")


@pytest.mark.parametrize("name", ["h5_state_family_stage", "k12_eligibility_class", "k8_result_buckets", "h4_active_only",
                                  "k10_winner_gap", "k7_top_ranked", "k9_best_per_provider"])
def test_prices_are_reduced_by_the_tasks_that_read_them(spark, name):
    """No join or shuffle comes before the pick, and its sort holds no text that derives from stored columns."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = REGISTRY[name].build(session, SF)._jdf.queryExecution().executedPlan().toString()
    nodes = _up_to_the_shuffle(plan, "l_partkey")
    kinds = [re.match(r"\w+", node).group() for node in nodes]
    assert kinds[-3:] == ["Sort", "WindowGroupLimit", "Exchange"]
    assert not any("Join" in kind for kind in kinds) and not re.search("https://|concat", " ".join(nodes))


def test_texts_made_after_the_pick_are_the_same(spark):
    """Missing and unknown parts, missing names, dates and numbers, and ties in every order column but the last."""
    at = [None, datetime(2024, 1, 1), datetime(2024, 1, 2)]
    rows = [(order, part, supplier, line, 3.0, price, 0.0, None, mode, tier, day) for order, part, line in ((7, 1, 6), (8, 1, 7), (None, 1, None), (9, 2, 1), (9, None, 1), (9, -5, 1))
            for supplier in (4, None) for price in (1.005, None, 2.5) for mode, tier in (("N", "F"), ("N", None), (None, "X"), ("A", "O")) for day in at]
    rows += [(5, 3, 1, 2, None, None, None, None, None, None, None)]
    lines = spark.createDataFrame(rows, table_schema("lineitem"))
    parts = tables.load(spark, SF, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("provider"), F.col("p_name").alias("model_name"))
    entities = parts.filter("entity_id <= 4").unionByName(parts.limit(1).withColumn("entity_id", F.lit(None).cast("long")))
    capabilities = views.capabilities(spark, SF).drop("provider", "lifecycle_state")

    def found(prices, shown=None):
        got = explore.current_entries(entities, prices, capabilities, views.lifecycle_obs(spark, SF), F.lit("2024-01-01").cast("timestamp"), ORDER,
                                      ["observed_at", "run_id"], "n", ("f", "x"), shown)
        return got.columns, sorted(map(str, got.collect()))

    want = found(views.price_obs(spark, SF, lines))
    assert found(views.price_lines(spark, SF, lines), lambda picked: views.price_shown(spark, SF, picked)) == want
    assert len(want[1]) == 6 and sum("price_mode='n', price_tier='f', price_snapshot_id='9-1-4-2-250'" in r for r in want[1]) == 1


def test_a_session_that_came_with_utc_is_bounded_once(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    other.conf.set(SPLIT, "128m")
    tables.load(other, SF, "part")
    assert int(other.conf.get(SPLIT)) == SPLIT_BYTES
    other.conf.set(SPLIT, "64m")
    tables.load(other, SF, "part")
    assert other.conf.get(SPLIT) == "64m"


def test_a_task_reads_a_bounded_part_of_a_file(spark):
    before = spark.conf.get(SPLIT)
    try:
        for given, kept in (("128m", SPLIT_BYTES), ("134217728b", SPLIT_BYTES), ("1MB", 1 << 20), ("65536", 1 << 16)):
            spark.conf.set(SPLIT, given)
            tune(spark)
            assert int(spark.conf.get(SPLIT)) == kept
    finally:
        spark.conf.set(SPLIT, before)


def test_lineage_cleans_a_value_after_its_row_is_made(spark):
    rows = [(1, '{"Model Name": "a <b>b</b>  c", "mode": null, "currency": "token=abcdefgh"}'), (2, None), (3, '[{"name": "x"}]')]
    df = spark.createDataFrame(rows, "id int, raw string")
    found = lineage.lineage(df, ["id"], "raw", {"modelName": F.lit("m"), "pricingMode": F.lit(None), "currency": F.col("id")})
    got = {(r["id"], r["normalized_field"]): tuple(r)[2:] for r in found.collect()}
    assert got == {
        (1, "modelName"): ("m", "Model Name", "a b c", "mapped"), (1, "pricingMode"): (None, "mode", None, "mapped"),
        (1, "currency"): ("1", "currency", "[redacted]", "mapped"), (2, "modelName"): ("m", None, None, "derived"),
        (2, "pricingMode"): (None, None, None, "derived"), (2, "currency"): ("2", None, None, "derived"),
        (3, "modelName"): ("m", "name", "x", "mapped"), (3, "pricingMode"): (None, None, None, "derived"),
        (3, "currency"): ("3", None, None, "derived"),
    }
    # The generator only looks entries up: cleaning there would run uncompiled and several times for each field.
    generate = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line)
    assert "redacted" not in generate


def test_the_first_row_per_key_travels_once(spark):
    """Missing keys are keys and missing order values come first, as with a minimum; tasks reduce rows before the one shuffle."""
    rows = [(run, key, order, f"{run} {key} {order}") for run in ("a", "b", None) for key in (1, None) for order in (3, None, 1, 2) if (run, order) != ("b", None)]
    df = spark.createDataFrame(rows, "run string, key long, at long, wide string")
    found = sinks.one_per_key(df, ["run", "key"], ["at"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1 and found.columns == df.columns
    assert sorted(r["wide"] for r in found.collect()) == sorted(f"{run} {key} {1 if run == 'b' else None}" for run in ("a", "b", None) for key in (1, None))


def test_checks_of_shape_and_ends_match_no_more_than_they_must(spark):
    """The verdicts of the whole patterns, on odd texts too; length and ends are judged without scanning a text by pattern."""
    values = [None, "", " ", "a", " a", "a ", "a b", "a\u00a0", "\u2003a", "a\n", "a \u0085", "a\u0085", "\u0085", "b c", "x" * 100, "x" * 101, "é" * 100,
              "\U0001f600" * 100, "\U0001f600" * 101, "\U0001f600", "a\u2028", "-a", "Aa"]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")

    def broken(*checks):
        return [tuple(r) for r in df.orderBy("n").select(*checks).collect()]

    def whole(shape):
        return F.coalesce(~F.col("v").rlike(r"^(?=[\s\S]{1,100}\z)" + shape.removeprefix("^")), F.lit(False))

    shapes = (contracts.ANY_SHAPE, contracts.PROVIDER_SHAPE, contracts.SLUG_SHAPE, "a")
    found = [contracts.bad_shape("v", s, 100).broken for s in shapes]
    assert broken(*found) == broken(*[whole(s) for s in shapes])
    trimmed = F.coalesce(F.col("v") != text.trim_text(F.col("v")), F.lit(False))
    assert broken(contracts.not_trimmed("v").broken) == broken(trimmed)
    plan = df.select(*found, contracts.not_trimmed("v").broken)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=" not in plan and "regexp_replace(v#" not in plan


def test_two_deliveries_come_from_one_pass(spark):
    """The rows that a join of all observations with the first delivery gives, missing key parts and times included."""
    at = [None, datetime(1997, 5, 1), datetime(1997, 12, 31, 23), datetime(1998, 1, 1), datetime(2000, 3, 1)]
    rows = [(run, entity, mode, "t", f"{run}-{n}", day) for run in (1, 2, None) for entity in (5, None) for mode in ("n", None)
            for n, day in enumerate(at[run or 0:] + at[:1] * (run == 2))]
    rows += [(7, 5, "n", "t", f"same-{n}", day) for n, day in ((1, at[1]), (0, at[1]), (2, at[4]))]
    obs = spark.createDataFrame(rows, "run_id long, entity_id long, mode string, tier string, snapshot_id string, observed_at timestamp")
    first = obs.filter("observed_at < timestamp '1998-01-01'").groupBy("run_id", *KEY).agg(
        F.min("snapshot_id").alias("snapshot_id"), F.lit("1997-12-01").cast("timestamp").alias("observed_at"))
    known = first.select("run_id", *KEY, F.col("observed_at").alias("_at"))
    every = obs.join(known, ["run_id", *KEY], "left").withColumn("observed_at", F.coalesce("_at", "observed_at"))
    later = every.groupBy("run_id", *KEY).agg(F.min("snapshot_id").alias("snapshot_id"), F.min("observed_at").alias("observed_at"))
    seen = admission.sighted_keys(obs)
    for got, want in zip(admission.two_deliveries(seen), (first, later)):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert seen._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_the_month_of_an_append_is_made_after_the_search_by_key(spark):
    rows = spark.createDataFrame([("r", "e", "m", None, "s", datetime(2024, 1, 31))] * 2, "run_id string, entity_id string, mode string, tier string, snapshot_id string, observed_at timestamp")
    dated = sinks.conform(rows.withColumn("month", F.date_format("observed_at", "yyyy-MM")), "fact_price")
    fresh = sinks.fresh_snapshots(rows, dated, dated.filter("false"), "fact_price", ["snapshot_id"])
    assert [(r.snapshot_id, r.month) for r in fresh.collect()] == [("s", "2024-01")]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(n for n, line in enumerate(plan) if "Window" in line)
    assert any("yyyy-MM" in line for line in plan[:window]) and not any("yyyy-MM" in line for line in plan[window:])


def test_a_price_history_travels_once_without_derived_texts(spark):
    """Lines are dealt once, nothing is stored in between and no text that derives from stored columns is sorted."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = REGISTRY["f9_price_history_changes"].build(session, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ExistingRDD" not in plan  # lines and parts
    below = plan[plan.index("Window [lag"):]
    assert not re.search("https://|concat", below)


def test_texts_made_after_the_pairs_are_the_same(spark):
    """Missing names, dates and numbers, unknown and missing parts, and repeats."""
    at = [None, datetime(2024, 1, 1), datetime(2024, 1, 2)]
    rows = [(order, part, supplier, line, 3.0, price, 0.0, None, mode, "F", day) for order, part, line in ((7, 1, 6), (8, 1, 7), (None, 1, None), (9, 2, 1), (9, None, 1), (9, -5, 1))
            for supplier in (4, None) for price in (1.005, None, 2.5) for mode in ("N", None) for day in at]
    lines = spark.createDataFrame(rows + rows[:5], table_schema("lineitem"))
    want = diff.price_history_changes(views.price_obs(spark, SF, lines), KEY, ORDER, F.lit(0))
    stored = views.known_prices(spark, SF, views.price_lines(spark, SF, lines))
    got = diff.price_history_changes(stored, KEY, ORDER, derived=views.price_texts)
    assert got.columns == want.columns and got.count() > 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
