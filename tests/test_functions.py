"""Scalar functions on hand-written values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import labels, lineage, text, values


def apply(spark, inputs, expression, ddl="v string"):
    rows = spark.createDataFrame([(v,) for v in inputs], ddl).select(expression.alias("r")).collect()
    return [r["r"] for r in rows]


def test_token_count_takes_only_definite_figures(spark):
    inputs = ["128,000 tokens", "1M tokens", "128k", "1.5M", "200K tokens", "1.2345k", "approx 128k", "0", "", None, "-5", "12 words"]
    assert apply(spark, inputs, values.token_count(F.col("v"))) == [
        128000, 1000000, 128000, 1500000, 200000, None, None, None, None, None, None, None]


def test_modalities_are_folded_in_first_seen_order(spark):
    inputs = ["Vision, text;speech", "smell", "text text image", None]
    found = apply(spark, inputs, F.array_join(text.modalities_from_text(F.col("v")), ","))
    assert found == ["image,text,audio", "", "text,image", ""]


def test_english_dates_must_be_real_days(spark):
    inputs = ["August 5, 2025", "February 30, 2025", "August 2025", "August 05, 2025", "aug 5, 2025"]
    assert apply(spark, inputs, values.english_date(F.col("v"))) == [date(2025, 8, 5), None, None, None, None]


def test_retirement_notice_is_exact_or_bounded(spark):
    inputs = ["May 14, 2025", "Not sooner than May 14, 2025", "unknown", None]
    exact, bound = values.retirement_dates(F.col("v"))
    assert apply(spark, inputs, exact) == [date(2025, 5, 14), None, None, None]
    assert apply(spark, inputs, bound) == [None, date(2025, 5, 14), None, None]


def test_shutdown_table_states(spark):
    inputs = ["May 14, 2025", "May 2025", "No shutdown date announced", None]
    assert apply(spark, inputs, values.shutdown_state(F.lit(False), F.col("v"))) == ["deprecated", "deprecated", None, None]
    assert apply(spark, inputs, values.shutdown_observation(F.col("v"))) == [
        "date", "imprecise_date", "explicitly_unannounced", "unobserved"]
    assert apply(spark, inputs, values.shutdown_state(F.lit(True), F.col("v"))) == ["retired"] * 4


def test_identity_key_folds_compatibility_forms(spark):
    inputs = [" models/Gemini 2.5 Pro ", "ＧＰＴ－４ｏ", "ﬁne²", "--A__b--", "Claude  Opus", "Café X", "Cafe\u0301 X"]
    assert apply(spark, inputs, text.identity_key(F.col("v"))) == ["gemini-2-5-pro", "gpt-4o", "fine2", "a-b", "claude-opus", "caf-x", "caf-x"]


@pytest.mark.parametrize("provider,name,family", [
    ("anthropic", "claude-3-5-sonnet-20241022", "claude-3-5-sonnet"),
    ("gemini", "gemini-2-5-flash-001", "gemini-2-5-flash"),
    ("gemini", "gemini-2-5-pro-preview-001", "gemini-2-5-pro-preview-001"),
    ("openai", "gpt-4o-2024-08-06", "gpt-4o"),
    ("openai", "gpt-4o-mini", "gpt-4o-mini"),
    ("xai", "grok-4-20-0309", "grok-4-20"),
    ("other", "x-20240101", "x-20240101"),
])
def test_family_key_drops_dates_only(spark, provider, name, family):
    assert apply(spark, [name], text.family_key(F.col("v"), F.lit(provider))) == [family]


def test_urls(spark):
    inputs = ["https://u:p@Host.example.com:443/a/b?x=1#y", "http://h.example.com", "ftp://h/a", "not a url", None]
    assert apply(spark, inputs, text.safe_url(F.col("v"))) == [
        "https://host.example.com/a/b", "http://h.example.com/", None, None, None]
    assert apply(spark, inputs, text.is_http_url(F.col("v"))) == [True, True, False, False, False]
    assert apply(spark, ["https://h/models/x-1/", "https://h", "::"], text.last_path_segment(F.col("v"))) == ["x-1", None, None]


def test_clean_text_redacts_and_cuts(spark):
    inputs = ["failed token=abc123 <b>x</b>   end", "Bearer abcdefgh1234", "   ", "x" * 300]
    found = apply(spark, inputs, text.clean_text(F.col("v"), 50))
    assert found[0] == "failed [redacted] x end"
    assert found[1] == "[redacted]"
    assert found[2] is None
    assert found[3] == "x" * 49 + "…"


def test_enumerated_ids(spark):
    inputs = ["imagen-4.0 imagen-4.1", "imagen-4.0, veo-3", "imagen-4.0", "imagen-4.0 and", "a-1 a-1", "imagen veo-3"]
    assert apply(spark, inputs, F.array_join(text.enumerated_ids(F.col("v")), "|")) == [
        "imagen-4.0|imagen-4.1", "imagen-4.0|veo-3", None, None, None, None]


def test_three_state_flags_never_turn_absence_into_false(spark):
    flags = spark.createDataFrame([(True, False), (False, True), (None, True), (None, False), (None, None)], "e boolean, s boolean")
    found = [r[0] for r in flags.select(values.observed_flag(F.col("e"), F.col("s"))).collect()]
    assert found == [True, False, True, None, None]


def test_exact_half_up(spark):
    inputs = [1.65, 1.75, -1.75, 0.25, 12.345, -0.05, 1.005, 2.5]
    assert apply(spark, inputs, values.to_fixed(F.col("v"), 1), "v double") == [1.6, 1.8, -1.8, 0.3, 12.3, -0.1, 1.0, 2.5]
    assert apply(spark, [1.005, 3.125, -3.125, 33.333], values.to_fixed(F.col("v"), 2), "v double") == [1.0, 3.13, -3.13, 33.33]


def test_price_delta_has_no_percent_from_zero(spark):
    pairs = spark.createDataFrame([(2.0, 3.0), (0.0, 3.0), (3.0, 2.0), (None, 1.0)], "o double, n double")
    absolute, percent = values.price_delta(F.col("o"), F.col("n"))
    assert [tuple(r) for r in pairs.select(absolute, percent).collect()] == [(1.0, 50.0), (3.0, None), (-1.0, -33.33), (None, None)]


def test_schedule(spark):
    rows = spark.createDataFrame(
        [(True, None), (True, datetime(2024, 1, 1, 0)), (True, datetime(2024, 1, 1, 9)), (False, datetime(2024, 1, 1, 0))],
        "enabled boolean, last timestamp")
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    reason = values.due_reason(F.col("enabled"), F.col("last"), F.lit(360), now)
    assert [r[0] for r in rows.select(reason).collect()] == ["never_run", "cadence_elapsed", "not_due", "disabled"]


def test_hash_changes_only_with_priced_values(spark):
    rows = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, 2.0), (None, 1.0)], "a double, b double")
    digest = values.price_hash([F.col("a"), F.col("b")], F.lit("USD"), F.lit("u"))
    hashes = [r[0] for r in rows.select(digest).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 3


def test_significance_bands(spark):
    rows = spark.createDataFrame(
        [("price_decreased", "pricing", 50.0, "x"), ("price_increased", "pricing", -20.0, "x"), ("price_increased", "pricing", 10.0, "x"),
         ("price_increased", "pricing", 1.0, "x"), ("price_increased", "pricing", None, "x"), ("model_added", "catalog", None, "big-opus"),
         ("model_added", "catalog", None, "x"), ("model_removed", "catalog", None, "x"), ("metadata_changed", "metadata", None, "x")],
        "k string, c string, p double, n string")
    score = labels.significance(F.col("k"), F.col("c"), F.col("p"), F.col("n"))
    assert [r[0] for r in rows.select(score).collect()] == [92, 82, 70, 55, 65, 95, 85, 75, 50]


def test_lineage_prefers_the_first_alias(spark):
    raw = '{"Mode": "batch", "price_input": 3, "inputPrice": 2, "extra": {"a": 1}}'
    rows = spark.createDataFrame([(1, raw)], "id int, raw string")
    wanted = {"pricingMode": F.lit("batch"), "inputPricePer1MTokens": F.lit(2.0), "currency": F.lit("USD")}
    found = {r["normalized_field"]: (r["raw_field"], r["raw_value"], r["derivation"])
             for r in lineage.lineage(rows, ["id"], "raw", wanted).collect()}
    assert found == {
        "pricingMode": ("Mode", "batch", "mapped"),
        "inputPricePer1MTokens": ("inputPrice", "2", "mapped"),
        "currency": (None, None, "derived"),
    }
