"""Explicit schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


# Input tables. Timestamps are read as instants, so filters on them need no cast.
TABLE_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table_schema(name: str) -> T.StructType:
    return _struct(TABLE_DDL[name])


MONEY = "DECIMAL(20,8)"

# Canonical tables of the snapshot ledger.
LEDGER_DDL = {
    "dim_provider": "provider_id STRING, slug STRING, name STRING, homepage_url STRING",
    "dim_source": "source_id STRING, provider_id STRING, kind STRING, collector_id STRING, source_url STRING,"
    " label STRING, is_active BOOLEAN",
    "dim_entity": "entity_id STRING, provider_id STRING, name STRING, display_name STRING,"
    " metadata MAP<STRING,STRING>, is_active BOOLEAN, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP,"
    " lifecycle_state STRING, deprecated_on DATE, retirement_date DATE, retirement_not_before_date DATE,"
    " lifecycle_source_id STRING, lifecycle_observed_at TIMESTAMP",
    "dim_alias": "provider_id STRING, entity_id STRING, source_id STRING, alias STRING, alias_type STRING,"
    " first_seen_at TIMESTAMP, last_seen_at TIMESTAMP",
    "fact_run": "run_id STRING, source_id STRING, status STRING, external_run_id STRING, triggered_by STRING,"
    " started_at TIMESTAMP, completed_at TIMESTAMP, records_seen BIGINT, records_accepted BIGINT, records_rejected BIGINT,"
    " error_message STRING, validation_errors ARRAY<STRUCT<record_index: INT, code: STRING, message: STRING>>",
    "fact_price": f"snapshot_id STRING, run_id STRING, source_id STRING, provider_id STRING, entity_id STRING,"
    f" mode STRING, tier STRING, input {MONEY}, cached {MONEY}, cache_write {MONEY}, output {MONEY},"
    " currency STRING, pricing_unit STRING, source_url STRING, raw STRING, content_hash STRING,"
    " observed_at TIMESTAMP, created_at TIMESTAMP",
    "fact_lifecycle": "snapshot_id STRING, run_id STRING, source_id STRING, provider_id STRING, entity_id STRING,"
    " api_id STRING, state STRING, deprecated_on DATE, retirement_date DATE, not_before_date DATE,"
    " not_before_observation STRING, replacement STRING, replacement_observed BOOLEAN, source_url STRING,"
    " raw STRING, content_hash STRING, observed_at TIMESTAMP, created_at TIMESTAMP",
    "fact_capability": "snapshot_id STRING, run_id STRING, source_id STRING, provider_id STRING, entity_id STRING,"
    " api_id STRING, display_name STRING, family STRING, stage STRING, context_window BIGINT,"
    " max_output_tokens BIGINT, supports_vision BOOLEAN, supports_tool_calling BOOLEAN,"
    " input_modalities ARRAY<STRING>, output_modalities ARRAY<STRING>, supported_features ARRAY<STRING>,"
    " source_url STRING, raw STRING, content_hash STRING, observed_at TIMESTAMP, created_at TIMESTAMP",
    "fact_change": "event_id STRING, provider_id STRING, source_id STRING, run_id STRING, entity_id STRING,"
    " change_type STRING, field_name STRING, mode STRING, tier STRING, old_value STRING, new_value STRING,"
    " prev_snapshot_id STRING, curr_snapshot_id STRING, domain STRING, summary STRING, detected_at TIMESTAMP",
    "fact_incident": "incident_id STRING, source_id STRING, run_id STRING, status STRING, severity STRING,"
    " reason_codes ARRAY<STRING>, summary STRING, records_seen BIGINT, records_valid BIGINT,"
    " records_invalid BIGINT, expected_count BIGINT, lkg_count BIGINT, lkg_run_id STRING, lkg_at TIMESTAMP,"
    " healing_attempt_count INT, created_at TIMESTAMP, resolved_at TIMESTAMP",
    "fact_quarantine": "incident_id STRING, source_id STRING, run_id STRING, position BIGINT, raw STRING,"
    " issues ARRAY<STRUCT<code: STRING, message: STRING>>",
    "fact_repair_attempt": "attempt_id STRING, incident_id STRING, source_id STRING, attempt_number INT,"
    " status STRING, started_at TIMESTAMP, completed_at TIMESTAMP",
    "fact_attempt": "attempt_id STRING, source_key STRING, status STRING, trigger STRING, started_at TIMESTAMP,"
    " completed_at TIMESTAMP, duration_ms BIGINT, records_accepted BIGINT, records_rejected BIGINT",
}


# Tables stored in folders per value of one more column.
PARTITIONS = {
    "fact_price": "month STRING", "fact_lifecycle": "month STRING", "fact_capability": "month STRING", "fact_change": "day DATE",
}


def ledger_schema(name: str) -> T.StructType:
    partition = f", {PARTITIONS[name]}" if name in PARTITIONS else ""
    return _struct(LEDGER_DDL[name] + partition)


# Raw observations as they arrive: loosely typed, position kept, corrupt lines kept.
RAW_PRICE_DDL = (
    "batch_id STRING, position BIGINT, provider STRING, model_name STRING, pricing_mode STRING,"
    " context_tier STRING, input_price_per_1m_tokens DOUBLE, cached_input_price_per_1m_tokens DOUBLE,"
    " cache_write_price_per_1m_tokens DOUBLE, output_price_per_1m_tokens DOUBLE, pricing_unit STRING,"
    " source_url STRING"
)
RAW_LIFECYCLE_DDL = (
    "batch_id STRING, position BIGINT, api_model_name STRING, current_state STRING, deprecated_date STRING,"
    " tentative_retirement_date STRING, product_page_url STRING"
)
RAW_SHUTDOWN_DDL = (
    "batch_id STRING, position BIGINT, model_id STRING, model_group STRING, model_stage STRING,"
    " release_date_raw STRING, shutdown_not_before_date_raw STRING, recommended_replacement STRING,"
    " product_page_url STRING, is_shutdown BOOLEAN"
)
RAW_CATALOG_DDL = (
    "batch_id STRING, position BIGINT, model_id STRING, display_name STRING, model_group STRING,"
    " context_window_raw STRING, max_output_tokens_raw STRING, supports_vision BOOLEAN,"
    " supports_function_calling BOOLEAN, input_modalities ARRAY<STRING>, output_modalities ARRAY<STRING>,"
    " supported_features ARRAY<STRING>, capability_statement STRING, source_url STRING"
)
