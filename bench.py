"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma list, or "all").
Each query is executed in full into the no-op sink after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow.queries.registry import QUERIES  # noqa: E402
from barflow.session import local_session  # noqa: E402

HEADLINE = [
    "bars_hourly", "bars_cascade", "tick_intensity_features", "orderbook_bar_features", "indicator_rsi", "indicator_macd", "indicator_adx",
    "indicator_kalman", "indicator_price_shape", "indicator_supertrend", "signals_all_rules", "labels_triple_barrier", "labels_event_time",
    "splits_walk_forward", "asof_backward", "asof_nearest", "trailing_day_mean", "training_frame_aligned", "trade_excursions", "quality_report",
    "drift_report", "classifier_metrics", "rolling_threshold", "mean_pairwise_correlation", "strategy_performance", "trade_ledger",
    "backtest_performance", "text_tone_documents", "news_coin_tags", "log_error_signatures", "linear_recurrence_varying_decay", "plateau_winners",
    "stream_window_bars", "stream_ema", "table_row_counts", "coverage_matrix", "series_inventory", "store_recent_news", "trades_backfilled", "trailing_stops",
    "backtest_walk_forward",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [w for w in wanted.split(",") if w] or HEADLINE
    spark = local_session("barflow-bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_hourly"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
        except Exception as e:  # report the others; a failed query has no time
            print(f"{name} failed: {str(e)[:300]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds over the benchmarked queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
