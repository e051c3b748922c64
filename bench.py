"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is fully
materialised with the ``noop`` sink (no driver collect); the value per
query is the median of warm runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "E3_vector_topk_batch": "vector_topk_batch",
    "E6_ann_topk": "ann_topk",
    "F6_evaluate_input": "evaluate_input",
    "H8_retrieve_knowledge": "retrieve_knowledge",
    "I4_scrub_pii": "scrub_pii",
    "J3_expire_sessions": "expire_sessions",
    "J13_route_turns": "route_turns",
    "A9_list_documents": "list_documents",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from railyard.session import local_session
    from railyard.plans.registry import queries

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="railyard-bench")
    qs = queries()
    times = {}
    for label, name in HEADLINE.items():
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[label] = round(statistics.median(samples), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
