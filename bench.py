"""Time the headline queries: BENCH_SF_DIR (folder) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Steps of the model and the reads on top of it, one or more from every part of the engine.
HEADLINE = (
    "submissions", "filing_parts", "filings", "position_sums", "positions", "price_check", "cusip_changes", "stock_keys", "securities",
    "stocks", "holders", "changes", "stock_periods", "manager_totals", "fundamentals_history", "stock_cash_flows",
    "stock_prices", "ranked_changes", "change_summary", "accumulate", "accumulate_past_lists", "accumulate_gaps",
    "backtest_quarters", "stock_series", "who_moved", "largest_weights", "manager_book", "book_summary",
    "left_out_rows", "search", "ftd_latest_symbol", "issuer_name_match", "resolve_stage", "source_reliability",
    "scan_filing_tsv", "agg_exact_median", "dq_invariants",
)
# Steps that other steps read and that have no query of their own.
STEPS = ("spelled_names", "quarter_prices", "cusip_moves", "position_pairs")
RUNS = 3


def main() -> None:
    from checks import QUERIES
    from checks.context import model
    from tidegauge.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    started = time.monotonic()
    built = model(spark, folder)
    built.build_tables()
    build_seconds = time.monotonic() - started

    def median_of(plan) -> float:
        taken = []
        for _ in range(1 + RUNS):  # the first is warm-up: compiled code, exported inputs
            begun = time.monotonic()
            plan().write.format("noop").mode("overwrite").save()
            taken.append(time.monotonic() - begun)
        return round(statistics.median(taken[1:]), 3)

    seconds = {name: median_of(lambda name=name: QUERIES[name](spark, folder)) for name in HEADLINE}
    steps = {name: median_of(lambda name=name: built.plan(name)) for name in STEPS}
    print(
        json.dumps(
            {
                "metric": "total of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "model_steps": steps,
                "model_build_sec": round(build_seconds, 1),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
