"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (timed runs per query, default 1, median reported),
BENCH_QUERIES (comma list to restrict).
Each query is executed in full (``write.format("noop")``: every row and
column is computed, nothing is collected to the driver). One warm-up query
runs first so JVM start-up is not charged to the first measurement.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_stage", "enrich_stage", "agg_month", "agg_season", "agg_weekday", "agg_global",
    "lexicon_emotions", "value_counts_pct", "overview", "histogram_tokens", "boxplot_lang",
    "weekday_patterns", "top_distress", "ctfidf_top_words", "ngram_df_filter", "topic_clusters",
    "langid_ngrams",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from textpulse.plans.registry import queries
    from textpulse.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    qs = queries()
    names = [q for q in (only or HEADLINE) if q in qs]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up (not timed): JVM JIT, analyzer, Python workers, on the smallest
    # data set when it is available.
    warm_dir = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    qs["enrich_stage"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: list[str] = []
    for name in names:
        try:
            times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
        except Exception as e:  # noqa: BLE001 - report, keep benchmarking
            print(f"bench: {name} failed: {str(e)[:200]}", file=sys.stderr)
            failed.append(name)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus} | ({"failed": failed} if failed else {})))
    spark.stop()
    if failed:  # a query that fails must not make the total look better
        sys.exit(1)


if __name__ == "__main__":
    main()
