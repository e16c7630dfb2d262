"""Change detection on micro tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from snapledger.operators import current, diff

DDL = ("entity_id string, mode string, tier string, snapshot_id string, input double, cached double, cache_write double,"
       " output double, pricing_unit string, source_url string")


def state(spark, *rows):
    return spark.createDataFrame([(e, "standard", t, f"{side}-{e}-{t}", i, None, None, o, "u", "s") for side, e, t, i, o in rows], DDL)


def events(df):
    return sorted((r["change_type"], r["entity_id"], r["tier"], r["field_name"]) for r in df.collect())


def test_increase_and_decrease_per_field(spark):
    prev, curr = state(spark, ("p", "a", "x", 1.0, 5.0)), state(spark, ("c", "a", "x", 2.0, 4.0))
    assert events(diff.diff_prices(prev, curr)) == [
        ("price_decreased", "a", "x", "outputPricePer1MTokens"), ("price_increased", "a", "x", "inputPricePer1MTokens")]


def test_unchanged_gives_nothing(spark):
    rows = state(spark, ("p", "a", "x", 1.0, 5.0), ("p", "b", "x", None, 2.0))
    assert diff.diff_prices(rows, rows).count() == 0


def test_added_tier_of_a_known_entity_keeps_its_tier(spark):
    prev = state(spark, ("p", "a", "x", 1.0, 1.0))
    curr = state(spark, ("c", "a", "x", 1.0, 1.0), ("c", "a", "y", 1.0, 1.0))
    assert events(diff.diff_prices(prev, curr)) == [("model_added", "a", "y", None)]


def test_new_entity_with_two_tiers_is_one_event_without_scope(spark):
    prev = state(spark, ("p", "b", "x", 1.0, 1.0))
    curr = state(spark, ("c", "b", "x", 1.0, 1.0), ("c", "a", "y", 1.0, 1.0), ("c", "a", "x", 1.0, 1.0))
    found = diff.diff_prices(prev, curr).collect()
    assert [(r["change_type"], r["entity_id"], r["mode"], r["tier"], r["curr_snapshot_id"]) for r in found] == [
        ("model_added", "a", None, None, "c-a-x")]


def test_removed_entity(spark):
    prev = state(spark, ("p", "a", "x", 1.0, 1.0), ("p", "a", "y", 1.0, 1.0), ("p", "b", "x", 1.0, 1.0))
    assert events(diff.diff_prices(prev, state(spark, ("c", "b", "x", 1.0, 1.0)))) == [("model_removed", "a", None, None)]


def test_null_against_price_is_metadata(spark):
    prev, curr = state(spark, ("p", "a", "x", None, 1.0)), state(spark, ("c", "a", "x", 2.0, None))
    assert events(diff.diff_prices(prev, curr)) == [
        ("metadata_changed", "a", "x", "inputPricePer1MTokens"), ("metadata_changed", "a", "x", "outputPricePer1MTokens")]


def test_input_order_does_not_matter(spark):
    rows = [("p", e, t, float(i), 1.0) for i, (e, t) in enumerate([("a", "x"), ("b", "x"), ("b", "y"), ("c", "x")])]
    curr = state(spark, ("c", "b", "x", 9.0, 1.0), ("c", "d", "x", 1.0, 1.0))
    forward, backward = state(spark, *rows), state(spark, *reversed(rows))
    assert events(diff.diff_prices(forward, curr)) == events(diff.diff_prices(backward, curr))


def test_duplicate_identity_fails_the_job(spark):
    twice = state(spark, ("p", "a", "x", 1.0, 1.0), ("p", "a", "x", 2.0, 1.0))
    with pytest.raises(Exception, match="duplicate price identity"):
        diff.diff_prices(twice, state(spark, ("c", "a", "x", 1.0, 1.0)), checked=True).collect()


def test_currency_is_compared_only_on_request(spark):
    prev = state(spark, ("p", "a", "x", 1.0, 1.0)).withColumn("currency", F.lit("USD"))
    curr = state(spark, ("c", "a", "x", 1.0, 1.0)).withColumn("currency", F.lit("EUR"))
    assert diff.diff_prices(prev, curr).count() == 0
    assert events(diff.diff_prices(prev, curr, compare_currency=True)) == [("metadata_changed", "a", "x", "currency")]


CAP_DDL = ("id string, context_window bigint, max_output_tokens bigint, supports_vision boolean, supports_tool_calling boolean,"
           " input_modalities array<string>, output_modalities array<string>, display_name string, family string, stage string")


def test_capability_arrays_compare_as_bags_and_absence_is_silent(spark):
    prev = spark.createDataFrame([("a", 1, None, None, True, ["x", "y"], [], "n", "f", None), ("gone", 1, 1, True, True, [], [], "n", "f", "s")], CAP_DDL)
    curr = spark.createDataFrame([("a", 2, None, True, None, ["y", "x"], ["t"], "n", "f", None), ("new", 1, 1, True, True, [], [], "n", "f", "s")], CAP_DDL)
    found = {(r["field_name"], r["old_value"], r["new_value"]) for r in diff.diff_capabilities(prev, curr, ["id"]).collect()}
    assert found == {("contextWindow", "1", "2"), ("supportsVision", None, "true"), ("supportsToolCalling", "true", None),
                     ("outputModalities", "[]", '["t"]')}


LIFE_DDL = ("id string, state string, deprecated_on date, retirement_date date, not_before_date date, not_before_observation string,"
            " replacement string, replacement_observed boolean")


def test_lifecycle_field_counts_only_if_asserted(spark):
    d = date(2025, 1, 1)
    prev = spark.createDataFrame([("a", "active", d, None, d, "date", "r1", True)], LIFE_DDL)
    silent = spark.createDataFrame([("a", None, None, None, None, "unobserved", None, False)], LIFE_DDL)
    spoken = spark.createDataFrame([("a", "retired", None, d, None, "explicitly_unannounced", None, True)], LIFE_DDL)
    assert diff.diff_lifecycle(prev, silent, ["id"]).count() == 0
    found = {(r["field_name"], r["old_value"], r["new_value"]) for r in diff.diff_lifecycle(prev, spoken, ["id"]).collect()}
    assert found == {("lifecycleState", '"active"', '"retired"'), ("retirementDate", None, '"2025-01-01"'),
                     ("retirementNotBeforeDate", '"2025-01-01"', None), ("recommendedReplacement", '"r1"', None)}


def test_lifecycle_fold_moves_the_retirement_pair(spark):
    d1, d2 = date(2025, 1, 1), date(2025, 6, 1)
    ddl = ("entity_id int, observed_at timestamp, run_id int, state string, deprecated_on date, retirement_date date,"
           " not_before_date date, not_before_observation string")
    from datetime import datetime

    def row(e, n, state=None, dep=None, exact=None, bound=None, seen="unobserved"):
        return (e, datetime(2024, 1, n), n, state, dep, exact, bound, seen)

    rows = spark.createDataFrame([
        row(1, 1, "active"), row(1, 2, "deprecated", d1, None, d1, "date"), row(1, 3, None, None, d2),
        row(2, 1, "active", None, d1), row(2, 2, None, None, None, d2, "date"), row(2, 3),
        row(3, 1, "retired", None, None, d1, "date"), row(3, 2, None, None, None, None, "explicitly_unannounced"),
    ], ddl)
    folded = {r["entity_id"]: (r["lifecycle_state"], r["deprecated_on"], r["retirement_date"], r["retirement_not_before_date"], r["is_active"])
              for r in current.fold_lifecycle(rows, ["entity_id"], ["observed_at", "run_id"]).collect()}
    assert folded == {1: ("deprecated", d1, d2, None, True), 2: ("active", None, None, d2, True), 3: ("retired", None, None, None, False)}
