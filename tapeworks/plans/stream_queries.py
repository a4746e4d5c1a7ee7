"""Stream queries: the given tables are written to a folder and drained as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.plans import fixtures as fx
from tapeworks.plans.registry import query, rounded, sql_rounded, sql_stamp, stamp
from tapeworks.plans.rule_queries import ARRIVALS, _arrivals
from tapeworks.session import scratch_path
from tapeworks.streaming import operators as ops
from tapeworks.streaming import runs


def _stream(spark, rows, name: str):
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return runs.table_stream(spark, path, rows.schema)


@query(
    "stream_chronology",
    f"""SELECT instrument_id, row_id FROM (SELECT *, max(ts) OVER (PARTITION BY instrument_id
    ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {ARRIVALS})
    WHERE ts <= top""",
)
def stream_chronology(spark, sf):
    marked = ops.chronology(_stream(spark, _arrivals(spark, sf), "arrivals"))
    return runs.drain(marked, "chronology").filter("out_of_order").select("instrument_id", "row_id")


@query("stream_dedup", "SELECT CAST(order_no AS VARCHAR) AS client_order_id FROM risk_orders GROUP BY order_no")
def stream_dedup(spark, sf):
    orders = _stream(spark, fx.risk_orders(spark, sf), "orders")
    first = ops.first_orders(orders).select("client_order_id")
    return runs.drain(first, "first-orders")


@query(
    "stream_quote_join",
    f"""SELECT CAST(o.arrival AS VARCHAR) AS client_order_id, arg_max(q.quote_price, q.quote_ts) AS price,
    {sql_stamp("max(q.quote_ts)")} AS quote_ts FROM risk_orders o JOIN
    (SELECT arrival, symbol, quote_price, quote_ts + arrival % 7 * INTERVAL 1 MICROSECOND AS quote_ts FROM risk_orders
      UNION ALL SELECT NULL, 'END', 0, TIMESTAMP '2100-01-01') q
    ON q.symbol = o.symbol AND q.quote_ts <= o.now AND q.quote_ts >= o.now - INTERVAL 30 SECOND
      AND q.arrival = o.arrival GROUP BY o.arrival""",
)
def stream_quote_join(spark, sf):
    base = fx.risk_orders(spark, sf)
    # The order number is part of the symbol, so each order has its own quote line.
    own = F.concat_ws("/", "symbol", F.col("arrival").cast("string"))
    key = F.col("arrival").cast("string").alias("client_order_id")
    end = F.lit("2100-01-01").cast("timestamp")
    # One closing row far ahead moves the watermarks past all real rows.
    first = base.limit(1)
    orders = base.select(key, own.alias("symbol"), "now").unionByName(
        first.select(F.lit("END").alias("client_order_id"), F.lit("END").alias("symbol"), end.alias("now"))
    )
    moved = F.timestamp_micros(F.unix_micros("quote_ts") + F.col("arrival") % 7)
    quotes = base.select(
        own.alias("symbol"), moved.alias("quote_ts"), F.col("quote_price").alias("price")
    ).unionByName(
        first.select(
            F.lit("FAR").alias("symbol"), end.alias("quote_ts"),
            F.lit(0).cast("decimal(18,2)").alias("price"),
        )
    )
    fresh = ops.freshest_quotes(
        _stream(spark, orders, "orders"), _stream(spark, quotes, "quotes"), 30
    )
    # The twin reports quoted orders only.
    rows = runs.drain(fresh, "fresh-quotes").filter("quote_ts IS NOT NULL")
    return rows.select("client_order_id", "price", stamp("quote_ts").alias("quote_ts"))


_VALUES = ["ema_12", "ema_26", "macd_signal", "rsi_14", "atr_14"]


@query(
    "stream_indicators",
    f"SELECT instrument_id, {sql_stamp()} AS ts, {sql_rounded(_VALUES, 2)} FROM recursive_values",
)
def stream_indicators(spark, sf):
    bars = fx.research_daily(spark, sf).select("instrument_id", "ts", "close", "high", "low")
    live = runs.drain(ops.indicators(_stream(spark, bars, "bars")), "indicators")
    return live.select("instrument_id", stamp().alias("ts"), *rounded(_VALUES, 2))
