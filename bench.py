"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the no-op sink (no collect), after a
warm-up pass of the same queries on the smallest scale factor, so JVM
start-up and code generation are not in the numbers. Prints one JSON
line: {"metric", "value", "unit", "queries", "sf", ...}.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemark.plans import registry  # noqa: E402
from pagemark.session import local_session, remove_tables  # noqa: E402

HEADLINE = (
    "page_markdown", "size_saving", "kept_blocks", "url_admission", "resource_admission",
    "redirect_chain", "response_routing", "snapshot_stable", "outcomes", "policy_replay",
    "token_bucket", "lookup_reuse", "redacted_log",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    qs = registry.queries()
    # Warm-up: JVM, Python workers and the code-generation cache, by running
    # every measured query once on the smallest scale (same plans, tiny data).
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    remove_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
