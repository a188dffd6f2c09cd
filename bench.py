"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all), BENCH_RUNS (default 2, best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "search_topk",
    "search_batch",
    "search_similar",
    "chunk_search",
    "chunk_extract",
    "chunk_roundtrip",
    "depth_histogram",
    "chunk_tree",
    "children_lists",
    "chunk_children",
    "embed_hash",
    "chunk_upsert",
    "token_totals",
    "scan_prune",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from indexloom.session import local_session
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "indexloom-bench")
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            # every row is produced in full, and none is kept
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
