"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the threads.
The study is the same at every scale: BENCH_INTERVAL_S (default 600) and BENCH_HISTORY (default 200 states) change it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barline.catalog import QUERIES  # noqa: E402
from barline.catalog.registry import DEFAULT, Tables, close  # noqa: E402
from barline.session import get_session  # noqa: E402

# What several queries read is built once, in this order, and timed on its own.
PRODUCTS = ("hourly", "bars", "states", "records", "two_sided")
HEADLINE = (
    "j1_resample", "v5_integrity", "v14_series_audit", "j12_interval_coverage", "f1_state_features", "f4_rolling_scaler", "o1_forward_outcomes", "j8_nearest_neighbours",
    "t5_target_records", "t3_two_sided_direction", "j18_candidate_matching", "w1_max_drawdown", "w1_drawdown_by_supplier", "w9_lagged_correlation", "a1_trade_statistics", "a8_context_atlas",
    "a10_hierarchical_contexts", "a13_calibration", "b1_bootstrap_means", "b2_block_bootstrap", "b4_ruin_probability", "b6_hac_pvalue", "q9_fresh_discovery", "q12_two_sided_confirmation",
    "q22_paper_fills", "r4_streamed_candles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = folder.rpartition("sf")[2]
    study = replace(DEFAULT, interval_s=int(os.environ.get("BENCH_INTERVAL_S", "600")), lookback=20, history=int(os.environ.get("BENCH_HISTORY", "200")))
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    tables = Tables(spark, folder, study)
    products: dict[str, float] = {}
    for name in PRODUCTS:
        started = time.perf_counter()
        getattr(tables, name)()
        products[name] = round(time.perf_counter() - started, 3)
    times: dict[str, float] = {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name].run(spark, folder, study).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    close(spark)
    spark.stop()
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "products": products, "sf": float(sf)}))


if __name__ == "__main__":
    main()
