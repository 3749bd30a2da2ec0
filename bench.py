"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (the whole plan
executes, nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callweave.session import build_session  # noqa: E402
from callweave.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "lookup_table", "table_summary", "metadata_relevance", "filter_search",
    "name_resolution_edges", "graph_nodes", "graph_statistics", "dependency_context", "call_paths",
    "connected_components", "vector_topk", "text_functions", "history_statistics",
    "search_graph_context", "stream_window_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts)
    t0 = time.time()
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not counted
    warm = time.time() - t0
    times, errors = {}, {}
    for name in names:
        t = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
        except Exception as e:  # record and go on: one failure must not hide the others
            errors[name] = repr(e)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "warmup_sec": round(warm, 3)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
