"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS override the data folder, the cores and the timed runs
per query (five). Each query runs once untimed, then its median counts; "spread" has the least and
the most of its runs. Results go to Spark's no-op sink, so every row and column is computed and
nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from forgemart.registry import QUERIES
from forgemart.session import local_session

HEADLINE = [
    "q1_released_and_backlog",
    "q2_bottleneck_ops",
    "q3_waiting_orders",
    "q4_top_scrap_group",
    "q5_posting_delay",
    "i04_measure_by_dims",
    "i05_drill_across",
    "j07_ops_hdr",
    "j14_widen",
    "j15_orphans",
    "d18_schedule",
    "a01_order_load",
    "a02_material_buffer",
    "a03_utilization",
    "a05_throughput_compare",
    "a06_precedence",
    "a07_delay_profile",
    "a08_queue_time",
    "a09_prioritize",
    "a10_bottleneck_board",
    "a11_output",
    "a12_sop",
    "a14_stock_cover",
    "a16_hierarchy_rollup",
    "a18_consumption",
    "k09_sequence",
    "s05_row_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, spread = {}, {}
    for name in names:
        timed(name)
        took = [timed(name) for _ in range(runs)]
        seconds[name] = round(statistics.median(took), 3)
        spread[name] = [round(min(took), 3), round(max(took), 3)]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "runs": runs,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
