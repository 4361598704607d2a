"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from evidquarry.plans import QUERIES
from evidquarry.session import build_session

RUNS = 3  # the median of these counts
HEADLINE = (
    "a1_count",
    "a4_overview",
    "a6_section",
    "a11_bm25_top_k",
    "s1_batch_vector_top_k",
    "a13_rrf",
    "c2_hybrid_retrieve",
    "c3_threshold_rerank",
    "w3_authoritative_versions",
    "a18_grouping_sets",
    "a31_latency_percentiles",
    "x34_material_claims",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # start executors and compile before timing
    timings: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
