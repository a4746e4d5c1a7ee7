import time
from datetime import timedelta

import pytest
from market import BAR_SCHEMA, walk
from pyspark.sql import functions as F
from test_trading import NOW

from tapeworks.functions.series import Grid
from tapeworks.operators.features import build_features
from tapeworks.streaming import operators as ops
from tapeworks.streaming import runs


def slices(spark, path, *parts):
    """Write each part as one later file, so every part is its own micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return runs.table_stream(spark, path, parts[0].schema, files_per_trigger=1)


def test_incremental_indicators_equal_batch(spark, tmp_path):
    bars = spark.createDataFrame(walk(120, "A", 1) + walk(50, "B", 2), BAR_SCHEMA)
    cut = F.lit(walk(120, "A", 1)[60][1])
    keep = ["instrument_id", "ts", "close", "high", "low"]
    early, late = bars.filter(F.col("ts") < cut).select(*keep), bars.filter(F.col("ts") >= cut).select(*keep)
    live = runs.drain(ops.indicators(slices(spark, str(tmp_path / "b"), early, late)), "ind")
    got = {(r.instrument_id, r.ts): r for r in live.collect()}
    want = build_features(bars, Grid(bar_seconds=60)).collect()
    assert len(got) == len(want) == 170
    for r in want:
        for name in ("ema_12", "ema_26", "macd_signal", "rsi_14", "atr_14"):
            mine = got[r.instrument_id, r.ts][name]
            assert mine == pytest.approx(r[name], abs=1e-9) if r[name] is not None else mine is None


def test_late_rows_are_flagged_across_batches(spark, tmp_path):
    schema = "instrument_id string, row_id bigint, ts timestamp"
    one = spark.createDataFrame([("A", 1, NOW), ("B", 2, NOW)], schema)
    two = spark.createDataFrame([("A", 3, NOW), ("B", 4, NOW.replace(hour=6))], schema)
    out = runs.drain(ops.chronology(slices(spark, str(tmp_path / "c"), one, two)), "chron")
    assert {r.row_id: r.out_of_order for r in out.collect()} == {1: False, 2: False, 3: True, 4: False}


def test_orders_without_a_fresh_quote_come_out(spark, tmp_path):
    at = lambda seconds: NOW + timedelta(seconds=seconds)
    orders = [("quoted", "HOT", at(60)), ("later", "HOT", at(70)), ("stale", "HOT", at(200)), ("none", "COLD", at(60))]
    quotes = [("HOT", at(40), 1.0), ("HOT", at(50), 2.0), ("HOT", at(65), 3.0), ("HOT", at(201), 4.0)]
    far = at(10_000_000)
    first = spark.createDataFrame(orders, "client_order_id string, symbol string, now timestamp")
    prices = spark.createDataFrame(quotes, "symbol string, quote_ts timestamp, price double")
    end, far_quote = spark.createDataFrame([("END", "END", far)], first.schema), spark.createDataFrame([("FAR", far, 0.0)], prices.schema)
    live = ops.freshest_quotes(
        slices(spark, str(tmp_path / "o"), first, end), slices(spark, str(tmp_path / "q"), prices, far_quote), 30
    )
    got = {r.client_order_id: r.price for r in runs.drain(live, "fresh").collect()}
    assert got == {"quoted": 2.0, "later": 3.0, "stale": None, "none": None}
