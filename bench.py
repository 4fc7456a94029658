"""Headline benchmark: wall seconds per query at one scale factor, printed as ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 2, best of),
     BENCH_QUERIES (comma-separated names; default: the headline set below).
Each query is executed in full with the ``noop`` sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["table_pipeline", "audit_report", "scan_and_mask", "spearman_matrix", "scale_numeric", "dirty_profile",
            "quality_score", "profile", "upsert_latest", "nearest_vector", "typos", "k_anonymity",
            "parse_requests", "drift_repair", "iman_conover", "autocorrelation", "synthetic_twin", "scenario_compare"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from weft.plans.registry import QUERIES, load_all
    from weft.session import get_spark

    load_all()
    spark = get_spark(app="weft-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before timing

    times: dict[str, float | None] = {}
    for n in names:
        best = None
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            try:
                QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001
                print(f"{n}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
                best = None
                break
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            spark.catalog.clearCache()
        times[n] = None if best is None else round(best, 3)

    ok = [v for v in times.values() if v is not None]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(ok), 3), "unit": "sec",
                      "queries": times, "sf": m.group(1) if m else sf_dir,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "failed": [k for k, v in times.items() if v is None]}))


if __name__ == "__main__":
    main()
