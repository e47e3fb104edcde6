"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Every query runs once to warm up (code generation, file listing) and is then timed in full: its
result is written to a sink that keeps nothing, so no column can be left out.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "trade_bars covered_bars volume_buckets vpin_on_grid ship_bars asof_backward volume_profile volume_profile_dedup day_levels footprint first_of_key hourly_coverage table_diff "
    "book_features book_bars return_features rsi backtest_stats walk_forward information_coefficient max_pain roll_spread wire_bybit_trades cost_model"
).split()


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark import session
    from tidemark.plans.catalog import QUERIES

    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for turn in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
