"""Stateful stream forms of the order-dependent operators.

State is keyed by instrument and lives in RocksDB. The rows of a key inside one
micro-batch are put in order first, so the source's batch cap bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.streaming.runs import use_rocksdb


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


# --- chronology --------------------------------------------------------------------------


class _Chronology(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["row_id"])
        floor = self.last.get()[0] if self.last.exists() else np.iinfo("int64").min
        us = batch["us"].to_numpy()
        top = np.maximum.accumulate(np.concatenate([[floor], us]))
        self.last.update((int(top[-1]),))
        yield pd.DataFrame(
            {
                "instrument_id": key[0],
                "row_id": batch["row_id"],
                "us": us,
                "out_of_order": us <= top[:-1],
            }
        )

    def close(self) -> None:
        pass


def chronology(stream: DataFrame) -> DataFrame:
    """Flags rows (instrument_id, row_id, ts) that do not come after all earlier ones."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select("instrument_id", "row_id", F.unix_micros("ts").alias("us"))
    marked = rows.groupBy("instrument_id").transformWithStateInPandas(
        statefulProcessor=_Chronology(),
        outputStructType="instrument_id string, row_id bigint, us bigint, out_of_order boolean",
        outputMode="Append",
        timeMode="None",
    )
    return marked.select(
        "instrument_id", "row_id", F.timestamp_micros("us").alias("ts"), "out_of_order"
    )


# --- duplicate ids -----------------------------------------------------------------------


def first_orders(stream: DataFrame, within: str | None = None) -> DataFrame:
    """First order per id: for ever, or within a watermark on ``now`` when given."""
    use_rocksdb(stream.sparkSession)
    if within is None:
        return stream.dropDuplicates(["client_order_id"])
    return stream.withWatermark("now", within).dropDuplicatesWithinWatermark(["client_order_id"])


# --- quote freshness ---------------------------------------------------------------------


def freshest_quotes(
    orders: DataFrame, quotes: DataFrame, max_age_seconds: int, delay: str = "1 hour"
) -> DataFrame:
    """Latest quote not older than the limit per order, by an interval join of two streams.

    An order without such a quote comes out with nulls, once the watermarks have passed it.
    """
    use_rocksdb(orders.sparkSession)
    o = orders.select("client_order_id", "symbol", "now").withWatermark("now", delay)
    q = quotes.select(
        F.col("symbol").alias("quote_symbol"), "quote_ts", "price"
    ).withWatermark("quote_ts", delay)
    age = F.expr(
        f"quote_symbol = symbol AND quote_ts <= now AND quote_ts >= now - INTERVAL {max_age_seconds} SECONDS"
    )
    found = o.join(q, age, "left_outer")
    return (
        found.groupBy(F.window("now", "1 minute").alias("w"), "client_order_id")
        .agg(F.max_by("price", "quote_ts").alias("price"), F.max("quote_ts").alias("quote_ts"))
        .select("client_order_id", "price", "quote_ts")
    )


# --- incremental indicators --------------------------------------------------------------

_VALUES = ["ema_12", "ema_26", "macd_signal", "rsi_14", "atr_14"]


@dataclass
class _Recurrence:
    """Last values of the recursive indicators of one instrument."""

    n: int = 0
    close: float = 0.0
    fast: float = 0.0
    slow: float = 0.0
    signal: float = 0.0
    gain: float = 0.0
    loss: float = 0.0
    tr: float = 0.0

    def push(self, close: float, high: float, low: float) -> list[float | None]:
        first = self.n == 0
        change = 0.0 if first else close - self.close
        spread = high - low
        if not first:
            spread = max(spread, abs(high - self.close), abs(low - self.close))
        self.fast = close if first else self.fast + (close - self.fast) * 2 / 13
        self.slow = close if first else self.slow + (close - self.slow) * 2 / 27
        macd = self.fast - self.slow
        self.signal = macd if first else self.signal + (macd - self.signal) * 0.2
        # Sums until the seed is complete, Wilder averages after it.
        up, down = max(change, 0.0), max(-change, 0.0)
        if self.n <= 14:
            self.gain, self.loss = self.gain + up, self.loss + down
            if self.n == 14:
                self.gain, self.loss = self.gain / 14, self.loss / 14
        else:
            self.gain, self.loss = (self.gain * 13 + up) / 14, (self.loss * 13 + down) / 14
        if self.n <= 13:
            self.tr += spread
            if self.n == 13:
                self.tr /= 14
        else:
            self.tr = (self.tr * 13 + spread) / 14
        rsi = None
        if self.n >= 14:
            if self.loss == 0:
                rsi = 50.0 if self.gain == 0 else 100.0
            else:
                rsi = 100 - 100 / (1 + self.gain / self.loss)
        atr = self.tr if self.n >= 13 else None
        self.n, self.close = self.n + 1, close
        return [self.fast, self.slow, self.signal, rsi, atr]


class _Indicators(StatefulProcessor):
    SCHEMA = (
        "n bigint, close double, fast double, slow double, signal double, gain double, "
        "loss double, tr double"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recurrence", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["us"])
        state = _Recurrence(*self.state.get()) if self.state.exists() else _Recurrence()
        values = [
            state.push(c, h, lo)
            for c, h, lo in zip(batch["close"], batch["high"], batch["low"], strict=True)
        ]
        self.state.update(tuple(vars(state).values()))
        out = pd.DataFrame(values, columns=_VALUES, dtype="float64")
        out.insert(0, "us", batch["us"])
        out.insert(0, "instrument_id", key[0])
        yield out

    def close(self) -> None:
        pass


def indicators(stream: DataFrame) -> DataFrame:
    """EMA 12/26, MACD signal, RSI 14 and ATR 14 from the last values instead of history."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select("instrument_id", F.unix_micros("ts").alias("us"), "close", "high", "low")
    schema = "instrument_id string, us bigint, " + ", ".join(f"{v} double" for v in _VALUES)
    out = rows.groupBy("instrument_id").transformWithStateInPandas(
        statefulProcessor=_Indicators(),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
    # Pandas carries a missing value as NaN.
    return out.select(
        "instrument_id",
        F.timestamp_micros("us").alias("ts"),
        *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in _VALUES],
    )
