"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vettica.plans.queries import queries
from vettica.session import build_session

HEADLINES = (
    "secret_scan",
    "split_lines",
    "code_tokens",
    "call_sites",
    "function_spans",
    "sink_candidates",
    "candidates_by_rule",
    "changed_files",
    "skip_report",
    "classify",
    "verify_candidates",
    "score_batches",
    "all_findings",
    "sarif_report",
    "scan_summary",
    "cascade",
    "incremental_scan",
    "eval_examples",
    "balance_per_language",
    "metrics_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINES
    catalogue = queries()
    cold, warm = {}, {}
    for name in chosen:
        for times in (cold, warm):
            began = time.perf_counter()
            # all columns of all rows are computed, nothing is written
            catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
