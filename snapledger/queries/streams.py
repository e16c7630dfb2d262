"""Streaming jobs run over the tables as file streams; each result must equal its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapledger.operators import contracts, gate
from snapledger.operators.temporal import build_evidence
from snapledger.queries.admission import GATE, manifest
from snapledger.queries.history import day, sql_day, stamp
from snapledger.queries.registry import REGISTRY, query
from snapledger.queries.scalars import EVIDENCE, lit_ts
from snapledger.queries.sqlviews import cte
from snapledger.schemas import table_schema
from snapledger.session import ensure_checkpoint_dir, tune
from snapledger.sources import views
from snapledger.sources.tables import load
from snapledger.streaming import changes, jobs, landing


def scratch(spark, name: str) -> str:
    """A new folder next to the checkpoints, on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark, folder: str, name: str):
    tune(spark)
    return jobs.read_files(spark, folder, table_schema(name), names=f"{name}.parquet")


@query(
    "s1_streaming_admission",
    GATE + "select batch_id, position, 'admitted' as outcome from marked where schema_ok and not duplicate and batch_id in (select batch_id from decision where not refused)"
    " union all select batch_id, position, 'quarantined' from marked where batch_id in (select batch_id from decision where refused)",
)
def s1_streaming_admission(spark, folder):
    """Every batch comes in pieces over three deliveries, its end mark in any of them, and is judged once and whole."""
    root = scratch(spark, "admission")
    announced = manifest(spark, folder)
    contract = contracts.price_contract()
    pieces = 3
    lines = load(spark, folder, "lineitem")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields]
    envelope = [F.col("l_orderkey").alias("batch_id"), F.lit(None).cast("string").alias("source_id"), F.lit("2024-01-01").cast("timestamp").alias("started_at"),
                F.lit(None).cast("string").alias("external_run_id"), F.lit("2024-01-01").cast("timestamp").alias("sent_at")]
    records = lines.select(*envelope, F.lit(None).cast("bigint").alias("expected"), *lines.columns, (F.col("l_linenumber") % pieces).alias("piece"))
    marks = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("expected"))
    marks = marks.select(*envelope, "expected", *nothing, (F.col("l_orderkey") % pieces).alias("piece"))
    sent = records.unionByName(marks)

    def judge(records, due, micro):
        validated = contracts.validate(views.raw_prices(spark, folder, records.select(*lines.columns)), contract)
        named = announced.join(due.select("batch_id"), "batch_id", "left_semi")
        decided = gate.decide(named, gate.batch_evidence(validated, contract)).checkpoint()
        kept = gate.admitted(contracts.first_valid(validated, contract), decided)
        held = gate.quarantined(validated, decided)
        outcomes = kept.select("batch_id", "position", F.lit("admitted").alias("outcome")).unionByName(
            held.select("batch_id", "position", F.lit("quarantined").alias("outcome")))
        outcomes.write.mode("overwrite").parquet(f"{root}/rows/micro={micro}")

    for piece in range(pieces):
        sent.filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(f"{root}/in")
        stream = jobs.read_files(spark, f"{root}/in", sent.drop("piece").schema)
        landing.landing_stream(stream, judge, f"{root}/landing", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/rows").drop("micro")


@query(
    "s2_replay_dedupe",
    cte("v_run_header") + "select distinct source_id, external_run_id, true as ended_well from v_run_header where status in ('succeeded', 'partial')"
    " union all select source_id, external_run_id, false from v_run_header where status not in ('succeeded', 'partial')",
)
def s2_replay_dedupe(spark, folder):
    root = scratch(spark, "replay")
    runs = views.run_headers(spark, folder, table_stream(spark, folder, "orders"))
    kept = jobs.first_delivery(runs)
    writer = kept.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{root}/rows").awaitTermination()
    ended_well = F.col("status").isin("succeeded", "partial").alias("ended_well")
    return spark.read.parquet(f"{root}/rows").select("source_id", "external_run_id", ended_well)


@query("s3_daily_counts", EVIDENCE + f"select {sql_day('detected_at', 'day')}, provider, category, count(*) as events from evidence group by 1, 2, 3")
def s3_daily_counts(spark, folder):
    root = scratch(spark, "daily")
    events = table_stream(spark, folder, "events")
    counts = jobs.daily_counts(build_evidence(views.changes(spark, folder, events)))
    jobs.write_updates(counts, f"{root}/rows", f"{root}/checkpoint")
    return jobs.newest_rows(spark, f"{root}/rows", ["day", "provider", "category"]).select(day("day"), "provider", "category", "events")


@query("s4_state_changes", REGISTRY["f9_price_history_changes"].sql)
def s4_state_changes(spark, folder):
    """The observations arrive in four deliveries, each a run of the stream that goes on from the stored states."""
    root = scratch(spark, "changes")
    lines = load(spark, folder, "lineitem")
    bounds = [None, "1996-07-01", "1998-01-01", "1999-07-01", None]
    at = F.col("l_shipdate")
    for low, high in zip(bounds, bounds[1:]):
        part = lines.filter(at >= F.lit(low).cast("timestamp")) if low else lines
        part = part.filter(at < F.lit(high).cast("timestamp")) if high else part
        part.write.mode("append").parquet(f"{root}/in")
        stored = views.price_lines(spark, folder, jobs.read_files(spark, f"{root}/in", table_schema("lineitem")))
        stream = views.known_prices(spark, folder, stored)
        changes.change_stream(stream, f"{root}/events", f"{root}/checkpoint", views.PRICE_IDENTITY, views.PRICE_ORDER, derived=views.price_texts)
    rows = spark.read.parquet(f"{root}/events")
    return rows.select(*views.PRICE_IDENTITY, stamp("observed_at"), "prev_snapshot_id", "curr_snapshot_id", "field_name", "change_type", "old_num", "new_num")


@query(
    "s5_silent_sources",
    cte("v_run_header") + """select source_id, case when age is null then 'unknown' when age > 525600 then 'stale' when age > 262800 then 'aging' else 'fresh' end as freshness, age as age_minutes,
  cast(floor((epoch_us(timestamp '2001-08-02') - epoch_us(last_start)) / 60000000.0) as bigint) > 43200 as overdue
from (select source_id, max(started_at) as last_start, cast(floor((epoch_us(timestamp '2001-08-02') - epoch_us(max(started_at) filter (status = 'succeeded'))) / 60000000.0) as bigint) as age
  from v_run_header group by 1)""",
)
def s5_silent_sources(spark, folder):
    root = scratch(spark, "silent")
    runs = views.run_headers(spark, folder, table_stream(spark, folder, "orders"))
    jobs.starts_stream(runs, f"{root}/rows", f"{root}/checkpoint")
    judged = jobs.silent_now(spark, f"{root}/rows", lit_ts("2001-08-02"), F.lit(43200), F.lit(525600))
    return judged.select("source_id", "freshness", "age_minutes", "overdue")
