"""Scans: parquet tables, raw JSON observations, and the read paths over the ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.operators.ordered import top_per_key
from snapledger.schemas import table_schema
from snapledger.session import BOUNDED, bound_reads, tune


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table with its declared schema."""
    # Once; settings a caller makes later stay.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        tune(spark)
    elif spark.conf.get(BOUNDED, None) is None:  # a session that came with UTC
        bound_reads(spark)
    return spark.read.schema(table_schema(name)).parquet(f"{folder}/{name}.parquet")


def load_raw(spark: SparkSession, path: str, ddl: str, corrupt_column: str = "corrupt_record") -> DataFrame:
    """Raw JSON observations, one per line.

    A line that does not parse stays in the result with its text in ``corrupt_record``, so a batch's
    record count never depends on whether its records were well formed.
    """
    schema = T.StructType.fromDDL(f"{ddl}, {corrupt_column} STRING")
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt_column)
        .json(path)
    )


def explode_batches(batches: DataFrame, payload: str, element_ddl: str, keys: Sequence[str]) -> DataFrame:
    """Batches stored as one JSON array each, turned into one row per record with its position."""
    # Elements stay JSON text first, so one malformed element cannot null its whole batch.
    texts = F.from_json(F.col(payload), "array<string>")
    exploded = batches.select(*keys, F.posexplode(texts).alias("position", "raw"))
    return exploded.select(*keys, "position", "raw", F.from_json("raw", element_ddl).alias("record"))


def _membership(column: str, wanted: Sequence | None) -> Column | None:
    return F.col(column).isin(list(wanted)) if wanted else None


def scan_current(
    current: DataFrame,
    *,
    provider: str | None = None,
    source: object | None = None,
    entity_ids: Sequence | None = None,
    mode: str | None = None,
    tier: str | None = None,
    order: Sequence[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Current-state rows narrowed by exact filters. A limit is applied last, never before a filter."""
    predicates = [
        F.col("provider") == provider if provider is not None else None,
        F.col("source_id") == source if source is not None else None,
        _membership("entity_id", entity_ids),
        F.col("mode") == mode if mode is not None else None,
        F.col("tier") == tier if tier is not None else None,
    ]
    result = current
    for predicate in predicates:
        if predicate is not None:
            result = result.filter(predicate)
    if limit is not None:
        result = result.orderBy(*(order or [])).limit(limit)
    return result


def scan_history(history: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], limit: int = 100) -> DataFrame:
    """The newest ``limit`` rows of every key, with ``rn`` = 1 for the newest.

    A key that holds a third of the table still sends only ``limit`` rows per task, see :func:`top_per_key`.
    """
    return top_per_key(history, keys, newest_first, limit, "rn")


def scan_changes(
    changes: DataFrame,
    *,
    provider: object | None = None,
    entity: object | None = None,
    types: Sequence[str] | None = None,
    since: datetime | str | None = None,
    order: Sequence[Column],
    limit: int | None = 50,
) -> DataFrame:
    """Newest change events after all filters."""
    result = changes
    if provider is not None:
        result = result.filter(F.col("provider") == provider)
    if entity is not None:
        result = result.filter(F.col("entity_id") == entity)
    if types:
        result = result.filter(F.col("change_type").isin(list(types)))
    if since is not None:
        bound = F.lit(since).cast("timestamp")
        result = result.filter(F.col("detected_at") >= bound)
        if "day" in changes.columns:  # the folder the ledger keeps a change in
            result = result.filter(F.col("day") >= F.to_date(bound))
    result = result.orderBy(*order)
    return result.limit(limit) if limit is not None else result
