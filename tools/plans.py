"""List plan features that would not scale, for every registered query.

    python tools/plans.py [--data FOLDER] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from snapledger.queries import REGISTRY  # noqa: E402
from snapledger.session import local_session  # noqa: E402

SUSPECT = {
    "cartesian": r"CartesianProduct",
    "nested loop": r"BroadcastNestedLoopJoin",
    "row python": r"BatchEvalPython",
    "collect": r"collect_list|collect_set",
    "single task": r"Exchange SinglePartition",
    "hinted broadcast": r"ResolvedHint|hint=.*broadcast",
}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--data", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("4", 4, "4g")
    # Without broadcasts every join shows the form it has for two large sides.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, q in REGISTRY.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        plan = q.build(spark, args.data)._jdf.queryExecution().executedPlan().toString()
        found = [label for label, pattern in SUSPECT.items() if re.search(pattern, plan)]
        shuffles = len(re.findall(r"Exchange (?:hash|range|Single)", plan))
        print(f"{name}: shuffles={shuffles} {'; '.join(found)}", flush=True)


if __name__ == "__main__":
    main()
