"""Headline workloads on one machine: one JSON line.

Bars and orders are first stored as tables, as a user would keep them; each workload is then run
once to warm up and three times measured, into a sink that drops the rows. The median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def build_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Small tables: let eight tasks share what a cluster would put in one partition.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = build_session()
    from tapeworks.functions.series import DAILY, HOURLY
    from tapeworks.operators import labels, performance, pricing, risk, rules, splits
    from tapeworks.operators import ledger as led
    from tapeworks.operators.features import build_features
    from tapeworks.plans import fixtures as fx
    from tapeworks.plans import ledger_queries as lq
    from tapeworks.plans import source_queries as sq
    from tapeworks.plans import trading_queries as tq
    from tapeworks.session import scratch_path, staged, tune
    from tapeworks.sources import bars as src
    from tapeworks.sources import sinks

    tune(spark)
    bars = staged(fx.research_daily(spark, SF_DIR), "bars")
    prices = staged(fx.bars_daily(spark, SF_DIR), "prices")
    fills = staged(fx.fills(spark, SF_DIR), "fills")
    equity = staged(fx.equity(spark, SF_DIR), "equity")
    dataset = staged(labels.label_rows(bars, DAILY, 5, 0.05, 0.6, 0.5), "labels")
    orders = staged(tq._rows(spark, SF_DIR), "orders")
    feed = sq._feed(spark, SF_DIR)

    def bar_import():
        raw = src.scan_csv(spark, feed, sq.MAPPING)
        good, _ = rules.split(rules.validate_bars(raw.filter("NOT bad_structure")))
        ordered = rules.chronology(good, ["source_file", "symbol"])
        sinks.write_bars(ordered.filter("NOT out_of_order"), scratch_path(spark, "import"))

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    work = {
        "bar_import": bar_import,
        "features_all": lambda: sink(build_features(bars, DAILY)),
        "label_rows": lambda: sink(labels.label_rows(bars, DAILY, 5, 0.05, 0.6, 0.5)),
        "walk_forward": lambda: sink(
            splits.fold_ranges(dataset, DAILY, splits.Folds(600, 150, 200))
        ),
        "next_open_fill": lambda: sink(
            pricing.next_open(prices.select("instrument_id", "ts"), prices.drop("volume"), DAILY)
        ),
        "risk_screen": lambda: sink(risk.risk_screen(orders, tq.POLICY)),
        "ledger": lambda: sink(
            led.ledger(led.inventory_clamp(fills, lq.GRID).filter("accepted"), lq.GRID)
        ),
        "perf_metrics": lambda: sink(performance.metrics(equity, HOURLY, 252, 0.02)),
    }
    counts = {"bar_import": prices.count(), "features_all": bars.count()}
    seconds = {}
    for name, run in work.items():
        run()
        times = []
        for _ in range(REPEATS):
            started = time.time()
            run()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": {n: round(counts[n] / seconds[n]) for n in counts},
                "rows": counts,
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
