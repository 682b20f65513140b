"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallystone.session import local_session
from workload import registry

HEADLINE = (
    "screen_watchlist",
    "metric_report_long",
    "exclude_checks",
    "cohort_zscores",
    "canonical_facts",
    "sec_facts",
    "edgar_index",
    "archive_versions",
    "fx_convert_instant",
    "fx_convert_duration",
    "scored_picks",
    "strategy_scores",
    "page_text",
    "red_flag_excerpts",
    "verify_findings",
    "call_cost_by_stage",
    "response_json",
    "report_markdown",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    registry.QUERIES["sector_of_sic"](spark, sf_dir).collect()  # start the JVM's code paths
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
