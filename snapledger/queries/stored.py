"""Reads of stored files made of the input tables: the current state, compacted, with deltas on top; raw JSON arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators.ordered import latest
from snapledger.queries.history import COMPARABLE_SQL, _latest_sql, day, sql_day
from snapledger.queries.registry import query
from snapledger.queries.sqlviews import cte
from snapledger.session import ensure_checkpoint_dir
from snapledger.sources import arrays, sinks, state, tables, views

# Two compactions and a delta after them: rows before the first come from the history, those between from deltas.
FIRST, SECOND = "1995-01-01", "1997-01-01"
NEWEST = "observed_at desc, snapshot_id desc"
PRICE_KEY = ["entity_id", "mode", "tier"]


def _ledger(spark: SparkSession, folder: str, table: str, rows: DataFrame) -> str:
    """A ledger whose runs arrived in three parts, each stored as an ingest stores it."""
    root = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    runs = views.run_headers(spark, folder).filter(F.col("status") != "running")
    sinks.conform(runs, "fact_run").write.parquet(f"{root}/fact_run")
    at = F.col("observed_at")
    part = F.when(at < F.lit(FIRST).cast("timestamp"), 0).when(at < F.lit(SECOND).cast("timestamp"), 1).otherwise(2)
    dated = sinks.conform(rows.withColumns({"created_at": at, "month": F.date_format(at, "yyyy-MM")}), table)
    parts = [dated.filter(part == n) for n in range(3)]
    parts[0].hint("rebalance", F.col("month")).write.partitionBy("month").parquet(f"{root}/{table}")
    state.compact(spark, root, table)
    state.remember(parts[1], root, table)
    state.compact(spark, root, table)
    state.remember(parts[2], root, table)
    return root


def stored_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Current comparable prices of every source, read from the stored state, under the names of the views."""
    rows = views.price_obs(spark, folder).withColumns({"provider_id": F.col("provider"), "source_id": F.col("supplier_id")})
    root = _ledger(spark, folder, "fact_price", rows)
    return state.read_current(spark, root, "fact_price").withColumns({
        "provider": F.col("provider_id"), "entity_id": F.col("entity_id").cast("bigint"),
        **{c: F.col(c).cast("double") for c in ("input", "cached", "cache_write", "output")}})


@query(
    "a2_stored_current",
    cte("v_price_obs", "v_run_header", cur=_latest_sql("v_price_obs", COMPARABLE_SQL, "supplier_id, entity_id, mode, tier", NEWEST))
    + "select cast(supplier_id as varchar) as source_id, entity_id, snapshot_id, input, cached, output, currency from cur"
    " where provider = 'Brand#1' and mode = 'a' and tier = 'f'",
)
def a2_stored_current(spark, folder):
    rows = tables.scan_current(stored_prices(spark, folder), provider="Brand#1", mode="a", tier="f")
    return rows.select("source_id", "entity_id", "snapshot_id", "input", "cached", "output", "currency")


@query(
    "g2_stored_comparable_price",
    cte("v_price_obs", "v_run_header")
    + f"select entity_id, mode, tier, snapshot_id, input, output from ({_latest_sql('v_price_obs', COMPARABLE_SQL, newest=NEWEST)})",
)
def g2_stored_comparable_price(spark, folder):
    rows = latest(stored_prices(spark, folder), PRICE_KEY, ["observed_at", "snapshot_id"])
    return rows.select(*PRICE_KEY, "snapshot_id", "input", "output")


@query(
    "g3_stored_lifecycle",
    cte("v_lifecycle", "v_run_header")
    + f"select entity_id, api_id, snapshot_id, state, replacement, {sql_day('deprecated_on')} from"
    f" ({_latest_sql('v_lifecycle', COMPARABLE_SQL, 'entity_id, api_id', NEWEST)})",
)
def g3_stored_lifecycle(spark, folder):
    rows = views.lifecycle_obs(spark, folder).withColumn("source_id", F.col("entity_id"))
    found = state.read_current(spark, _ledger(spark, folder, "fact_lifecycle", rows), "fact_lifecycle")
    return found.select(F.col("entity_id").cast("bigint").alias("entity_id"), "api_id", "snapshot_id", "state", "replacement", day("deprecated_on"))


@query(
    "a1_load_arrays",
    "select conv_id as doc_id, role, turn, cast(len(text) as bigint) as text_length, cast(null as varchar) as corrupt_record from conversations"
    " union all select null, null, null, null, cast(turn as varchar) from conversations",
)
def a1_load_arrays(spark, folder):
    # Every turn is stored in an array beside a record that is none; the files are then read by byte ranges.
    turns = tables.load(spark, folder, "conversations")
    told = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    root = f"{ensure_checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    turns.select(F.concat(F.lit("["), told, F.lit(", "), F.col("turn").cast("string"), F.lit("]"))).write.text(root)
    base = root if "://" in root or root.startswith("file:") else f"file://{root}"
    rows = arrays.load_arrays(spark, base, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return rows.select(
        F.col("record.conv_id").alias("doc_id"), "record.role", "record.turn", F.length("record.text").cast("bigint").alias("text_length"),
        "corrupt_record")
