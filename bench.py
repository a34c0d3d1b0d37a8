"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from sourceweave.plans import PLANS
from sourceweave.plans.retrieval import store
from sourceweave.session import get_session

HEADLINE = [
    "count_files_lines",
    "detect_changes",
    "directory_rollup",
    "extract_functions",
    "extract_calls",
    "extract_imports",
    "extract_api_calls",
    "extract_endpoints",
    "extract_model_fields",
    "detect_features",
    "dependency_edges",
    "most_depended_on",
    "chunk_lines",
    "hash_embed",
    "topk_search",
    "retrieve",
    "context_pack",
    "session_list",
    "latest_progress",
    "compare_versions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    start = time.time()
    store(spark, sf)  # the vectors that retrieval reads, as a user would keep them
    built = round(time.time() - start, 3)
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        PLANS[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    line = {
        "metric": "headline query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "build_vector_store": built,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
