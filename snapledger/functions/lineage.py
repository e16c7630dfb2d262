"""Which raw key produced which canonical value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import clean_text

# Canonical field -> raw spellings, tried in this order; case and separators are ignored.
PRICE_ALIASES = {
    "modelName": ("model_name", "model", "name", "modelId"),
    "pricingMode": ("pricing_mode", "mode"),
    "contextTier": ("context_tier", "context", "tier", "context_window"),
    "inputPricePer1MTokens": ("input_price_per_1m_tokens", "input_price", "input", "input_cost", "price_input"),
    "cachedInputPricePer1MTokens": (
        "cached_input_price_per_1m_tokens", "cached_input_price", "cached_input", "cache_read"),
    "cacheWritePricePer1MTokens": ("cache_write_price_per_1m_tokens", "cache_write_price", "cache_write"),
    "outputPricePer1MTokens": ("output_price_per_1m_tokens", "output_price", "output", "output_cost", "price_output"),
    "currency": ("currency",),
    "pricingUnit": ("pricing_unit", "unit"),
    "sourceUrl": ("source_url", "url", "page_url"),
    "observedAt": ("observed_at", "timestamp", "collected_at"),
}
LIFECYCLE_ALIASES = {
    "apiModelId": ("api_model_id", "api_model_name", "model_id", "model"),
    "lifecycleState": ("lifecycle_state", "current_state", "state", "model_stage", "stage"),
    "deprecatedOn": ("deprecated_on", "deprecation_date", "deprecated"),
    "retirementDate": ("retirement_date", "retirement", "shutdown_date", "retired_on"),
    "retirementNotBeforeDate": ("retirement_not_before_date", "retirement_not_before", "not_before"),
    "retirementNotBeforeObservation": ("retirement_not_before_observation",),
    "recommendedReplacement": ("recommended_replacement", "replacement", "recommended_model", "replacement_model"),
    "sourceUrl": ("source_url", "product_page_url", "url"),
    "observedAt": ("observed_at", "timestamp", "collected_at"),
}


def folded_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def raw_entries(raw: Column) -> Column:
    """Top-level entries of a JSON object as (folded, key, value); an array must hold one record and stands for it."""
    several = F.raise_error(F.lit("a raw record is an array of several records")).cast("string")
    only = F.when(F.coalesce(F.json_array_length(raw), F.lit(0)) > 1, several).otherwise(F.get_json_object(raw, "$[0]"))
    first = F.when(F.substring(F.ltrim(raw), 1, 1) == "[", only).otherwise(raw)
    entries = F.map_entries(F.from_json(first, "map<string,string>"))
    return F.transform(
        entries, lambda e: F.struct(folded_key(e["key"]).alias("folded"), e["key"].alias("key"), e["value"].alias("value"))
    )


def find_entry(entries: Column, aliases: Sequence[str]) -> Column:
    """The entry of the first alias that occurs."""
    folded = ["".join(ch for ch in alias.lower() if ch.isalnum()) for alias in aliases]
    places = [F.nullif(F.array_position(entries["folded"], name), F.lit(0)) for name in folded]
    return F.get(entries, (F.coalesce(*places) - 1).cast("int"))


def lineage(df: DataFrame, keys: Sequence[str], raw: str, normalized: Mapping[str, Column],
            aliases: Mapping[str, Sequence[str]] = PRICE_ALIASES) -> DataFrame:
    """One row per (record, canonical field): the raw key and value it came from, or ``derived``."""
    # An entry is looked up once per field; its text is cleaned after the rows are made, in compiled code.
    kept = df.withColumn("_entries", raw_entries(F.col(raw)))
    fields = [
        F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), find_entry(F.col("_entries"), aliases[field]).alias("entry"))
        for field, value in normalized.items()
    ]
    entry = F.col("f.entry")
    return kept.select(*keys, F.explode(F.array(*fields)).alias("f")).select(
        *keys, F.col("f.field").alias("normalized_field"), F.col("f.value").alias("normalized_value"),
        entry["key"].alias("raw_field"), clean_text(entry["value"], 120).alias("raw_value"),
        F.when(entry.isNotNull(), "mapped").otherwise("derived").alias("derivation"),
    )
