"""Time the headline queries; prints one JSON line.

Queries are timed with a noop write, so that results stay on the executors. The
first query pays for JVM warm-up, so one cheap query runs untimed before.
"""

from __future__ import annotations

import json
import os
import time

from tabaudit.catalog import all_queries
from tabaudit.session import local_session

HEADLINE = [
    "q_roles", "q_profile", "q_top_shares", "q_best_stratifier", "q_cell_report", "q_cell_report_by_key", "q_ks_vs_rest", "q_ks_pair",
    "q_complement", "q_offsets", "q_refine_shift", "q_numeric_audit_add", "q_numeric_audit_mul", "q_overwrite", "q_missingness",
    "q_period_collapse", "q_window_growth", "q_rough_series", "q_repair_from_reference", "q_repair_interpolate", "q_encode", "q_split3_exact",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    queries = all_queries()
    queries["q_null_rates"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
