"""Look for plan nodes that would not scale: nested-loop joins, single-partition exchanges, row-wise Python.

    python tools/plans.py [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sourceweave.plans import PLANS  # noqa: E402
from sourceweave.session import get_session  # noqa: E402

MARKS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition", "BroadcastExchange"]


def main() -> None:
    spark = get_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.001")
    for name, p in PLANS.items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        text = p.run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = [m for m in MARKS if m in text]
        print(f"{name}: exchanges={text.count('Exchange ')} {' '.join(found)}", flush=True)


if __name__ == "__main__":
    main()
