"""Wall time of the headline queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query runs to completion into the no-op sink, so all of its rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "flagship_price_movement", "a3_scan_history", "a5_new_snapshots", "a7_upsert_dimensions", "b14_issue_codes", "c11_identity_key",
    "c20_content_hash", "d17_admit_split", "e1_snapshot_dimensions", "e4_entity_evidence", "e5_identity_cascade", "e6_provenance_chain",
    "f1_diff_prices", "f5_diff_capabilities", "f6_diff_lifecycle", "f9_price_history_changes", "g1_latest_price", "g2_latest_comparable_price",
    "g7_health_view", "g15_lifecycle_fold", "h12_category_significance", "i2_temporal_order", "i4_significant_changes", "j1_event_metrics",
    "j5_facets", "j6_compare_providers", "k7_cost_ranking", "k13_workload_ranking", "l1_compare", "l3_name_resolution",
    "n2_unsupported_claims", "n3_question_tags", "s3_daily_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from snapledger.queries import REGISTRY
    from snapledger.session import local_session

    names = sys.argv[1:] or HEADLINE
    shared = tempfile.TemporaryDirectory(prefix="bench-checkpoints-")  # gone when the run ends
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "16g"), shared.name)
    # The first job pays for JVM and code generation start-up; it is not part of any query.
    REGISTRY["g1_latest_price"].build(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
