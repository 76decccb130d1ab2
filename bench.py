"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from apiquarry.plans import catalog
from apiquarry.session import build_session

HEADLINE = [
    "newest_match", "check_allowed", "redact_history", "mask_named", "resolve_templates", "json_path", "holds", "history_prune_deep",
    "rank_per_key", "export_har", "read_openapi", "read_raw_http", "detect_frameworks", "values_in_scope", "save_inventory",
    "coalesce_changes", "suppress_echo", "inventory_drift", "resolve_routes", "evaluate_runs", "json_paths", "warning_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "10g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
