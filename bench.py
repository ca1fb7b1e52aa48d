"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local threads,
``BENCH_QUERIES`` optionally a comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from spoor.session import local_session

HEADLINE = [
    "jaccard_topk",
    "jaccard_expected_rank",
    "jaccard_metrics",
    "hit_topk",
    "mean_pool_topk",
    "maxsim_topk",
    "maxsim_expected_rank",
    "semantic_topk",
    "semantic_expected_rank",
    "episode_topk_strict",
    "episode_summary_strict",
    "episode_summary_partial",
    "whiten_apply",
    "whiten_maxsim",
    "ordered_distinct_lines",
    "reduction_stats",
    "compact_profiles",
    "corpus_counts",
    "embed_per_rule",
    "embed_mean",
    "embed_whole",
    "runtime_window_match",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus)
    seconds = {}
    # Start the JVM's and the Python workers' machinery before the clock runs.
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
