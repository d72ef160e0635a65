"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma list, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholia import plans  # noqa: E402
from scholia.session import local_session  # noqa: E402

HEADLINE = ["index_write", "bm25_topk", "rrf", "hybrid_search", "sibling_expand", "knn_topk", "near_dup_leaders", "bfs_hops", "imports", "manifest_deps",
            "affected_files", "line_rules", "contradiction_guard", "scope_match", "usage_summary", "stream_index"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = plans.load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, name="bench")
    # start the task threads and their Python workers before the clock runs
    spark.range(0, 1000, 1, cpus).mapInPandas(lambda batches: batches, "id long").groupBy().sum("id").collect()
    times: dict[str, float] = {}
    for name in names:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
