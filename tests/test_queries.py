"""Registered queries against their SQL on the smallest data, when it is there."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import rows_of, types_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from snapledger.queries import REGISTRY  # noqa: E402
from snapledger.schemas import TABLE_DDL  # noqa: E402

FOLDER = os.environ.get("SNAPLEDGER_DATA", "/root/testdata/sf0.001")
# One query per family; SNAPLEDGER_ALL=1 runs all of them.
SOME = [
    "flagship_price_movement", "a1_load_arrays", "a3_scan_history", "a7_upsert_dimensions", "b14_issue_codes", "c12_family_key", "c20_content_hash",
    "c27_labels", "d15_reason_codes", "e4_entity_evidence", "e5_identity_cascade", "f1_diff_prices", "f7_event_order", "f9_price_history_changes",
    "g2_latest_comparable_price", "g7_health_view", "h12_category_significance", "i3_temporal_page", "j6_compare_providers", "k7_cost_ranking",
    "l3_name_resolution", "n2_unsupported_claims", "s3_daily_counts",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLE_DDL:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_a_check_and_a_plain_name():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())
    assert not [n for n in REGISTRY if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", sorted(REGISTRY) if os.environ.get("SNAPLEDGER_ALL") else SOME)
def test_query_matches_sql(spark, oracle, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert rows_of(frame.columns, got) == rows_of(columns, want)
    assert types_of(frame.columns, got) == types_of(columns, want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
