"""Wall seconds of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local cores).
Each query is run once to warm up, then timed BENCH_RUNS times (once by default);
the median is reported.  Results are computed in full and thrown away by the sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from waybridge import build_session
from waybridge.plans.catalog import QUERIES

HEADLINE = [
    "match_shipment", "match_reasons", "shipment_lines", "money_sanity", "required_fields",
    "normalize_money", "normalize_date", "normalize_fields", "document_confidence",
    "classify_top2", "rule_extract", "scan_detect", "segment_text", "page_digest",
    "split_choose", "redact_contacts", "idempotent_ingest", "cache_probe", "jobs_list",
    "rate_limit_accepted", "review_state_fold", "analytics_percentiles", "field_f1",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        timed = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
