"""Headline queries, raw and stored form, at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once untimed and is then timed ``REPEATS`` times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventide.plans import questions  # noqa: E402
from eventide.plans.market import LiveViews  # noqa: E402
from eventide.plans.store import StoredViews, TableStore, refresh  # noqa: E402
from eventide.plans.timing import run_ms  # noqa: E402
from eventide.session import local_session, table_bytes, tune  # noqa: E402
from eventide.sources.event_log import load_market  # noqa: E402

START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def headline(live: LiveViews, stored: StoredViews) -> dict:
    market = live.market
    both = {
        "q1_event_car": lambda v: questions.event_car(v, START, END),
        "q2_funding_deciles": lambda v: questions.funding_deciles(v, START, END),
        "q3_extreme_regimes": lambda v: questions.extreme_regimes(v, START, END, min_events=1),
        "q4_low_vol_safe_symbols": lambda v: questions.low_vol_safe_symbols(v, START, END),
        "q5_hourly_markouts": lambda v: questions.hourly_markouts(v, START, END),
        "q6_vol_regime_markouts": lambda v: questions.vol_regime_markouts(v, START, END),
    }
    runs = {}
    for name, question in both.items():
        runs[f"{name}_raw"] = lambda q=question: q(live)
        runs[f"{name}_stored"] = lambda q=question: q(stored)
    runs["q7_symbol_overview_raw"] = lambda: questions.symbol_overview_raw(market, START, END)
    runs["q7_symbol_overview_stored"] = lambda: questions.symbol_overview(stored, START, END)
    runs["q8_funding_pressure"] = lambda: questions.funding_pressure(live, START, END)
    runs["q9_post_event_volatility"] = lambda: questions.post_event_volatility(live, START, END)
    runs["q10_positive_moves"] = lambda: questions.positive_moves_30m(live, START, END)
    return runs


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    scratch = tempfile.mkdtemp(prefix="eventide-bench-")
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoint")

    tune(spark, table_bytes(spark, f"{folder}/events.parquet"))
    market = load_market(spark, folder)
    store = TableStore(spark, f"{scratch}/tables")
    begun = time.perf_counter()
    refresh(store, market)
    refreshed = time.perf_counter() - begun

    # A question is asked of its tables anew each time, as a user would.
    runs = headline(LiveViews(market), StoredViews(store, market))
    times = {}
    for name, build in runs.items():
        taken = []
        for _ in range(1 + REPEATS):
            taken.append(run_ms(build))
        times[name] = round(statistics.median(taken[1:]) / 1000, 4)
    total = round(sum(times.values()), 4)
    times["refresh_stored_tables"] = round(refreshed, 4)
    print(json.dumps({
        "metric": "event-study questions Q1-Q10, raw and stored, total of medians",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
