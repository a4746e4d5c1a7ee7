"""Causal indicators over bars. Warm-up rows are null; instruments never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.series import (
    Grid,
    affine_scan,
    block_window,
    last_of_earlier_blocks,
    memory_rows,
    owned,
    positions,
    split_series,
)
from tapeworks.session import staged

KEYS = ("instrument_id",)

def positive_period(period: int, least: int = 1) -> int:
    if type(period) is not int or period < least:
        raise ValueError(f"a period is a whole number of at least {least} bars, not {period!r}")
    return period


def frame(bars: DataFrame, grid: Grid, before: int, after: int = 0) -> DataFrame:
    cut = split_series(
        bars, KEYS, grid.bucket("ts"), before=before, after=after, block_rows=grid.block_rows
    )
    return positions(cut, KEYS, "ts")


def over(rows: int | None = None, *, first: int | None = None, last: int = 0):
    w = block_window(KEYS, "ts")
    if rows is not None:
        return w.rowsBetween(1 - rows, 0)
    return w if first is None else w.rowsBetween(first, last)


def warm(index_at_least: int, value: Column) -> Column:
    return F.when(F.col("_idx") >= index_at_least, value)


def lagged(column: str, rows: int = 1) -> Column:
    return F.lag(column, rows).over(over())


def ema_decay(period: int) -> float:
    return 1 - 2 / (period + 1)


def wilder_decay(period: int) -> float:
    return (period - 1) / period


def ema_forcing(value: Column, period: int) -> tuple[Column, float]:
    alpha = 2 / (period + 1)
    return F.when(F.col("_idx") == 0, value).otherwise(value * F.lit(alpha)), ema_decay(period)


def wilder_forcing(
    value: Column, window_mean: Column, seed_at: int, period: int
) -> tuple[Column, float]:
    u = (
        F.when(F.col("_idx") < seed_at, F.lit(0.0))
        .when(F.col("_idx") == seed_at, window_mean)
        .otherwise(value / F.lit(period))
    )
    return u, wilder_decay(period)


def true_range(previous_close: Column) -> Column:
    span = F.col("high") - F.col("low")
    return F.when(previous_close.isNull(), span).otherwise(
        F.greatest(
            span, F.abs(F.col("high") - previous_close), F.abs(F.col("low") - previous_close)
        )
    )


def with_moves(df: DataFrame, period: int, column: str = "close") -> DataFrame:
    """Gains and losses per bar with their ``period`` means for the Wilder seed."""
    change = F.coalesce(F.col(column) - lagged(column), F.lit(0.0))
    df = df.withColumn("_chg", change).withColumns(
        {
            "_gain": F.greatest(F.col("_chg"), F.lit(0.0)),
            "_loss": F.greatest(-F.col("_chg"), F.lit(0.0)),
        }
    )
    return df.withColumns(
        {
            "_gain_mean": F.avg("_gain").over(over(period)),
            "_loss_mean": F.avg("_loss").over(over(period)),
        }
    )


def move_terms(period: int) -> dict[str, tuple[Column, float]]:
    return {
        "_g": wilder_forcing(F.col("_gain"), F.col("_gain_mean"), period, period),
        "_l": wilder_forcing(F.col("_loss"), F.col("_loss_mean"), period, period),
    }


def rsi_from_moves(df: DataFrame, period: int) -> DataFrame:
    """``_rsi_at`` where a price has moved, ``_rsi_here`` the last of these in the block.

    An unchanged price scales both averages alike, so such rows repeat the last value, however far
    back it is; 50 stands only where no price has moved yet.
    """
    g, l = F.col("_g"), F.col("_l")
    value = F.when(l == 0, F.when(g == 0, F.lit(50.0)).otherwise(F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(g, l))
    )
    # A period of one bar remembers nothing that could be repeated.
    moved = (F.col("_chg") != 0) | F.lit(period == 1)
    moving = (F.col("_idx") == period) | ((F.col("_idx") > period) & moved)
    # Copied rows lack the memory that makes values right; only a block's own rows may be repeated.
    df = df.withColumn("_rsi_at", F.when(moving & F.col("_own"), value))
    fill = block_window(KEYS, "ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_rsi_here", F.last("_rsi_at", ignorenulls=True).over(fill))


def with_carried_rsi(df: DataFrame, name: str, period: int) -> DataFrame:
    """The RSI, with the last value of earlier blocks where none of a block has moved yet.

    The frame is written, so that the values handed on are taken from it without making it twice.
    """
    df = last_of_earlier_blocks(staged(df, "frame"), KEYS, "_rsi_at", "_rsi_before")
    return df.withColumn(name, warm(period, F.coalesce("_rsi_here", "_rsi_before")))


def returns(bars: DataFrame, grid: Grid, column: str = "close") -> DataFrame:
    df = frame(bars, grid, 1)
    return owned(df.withColumn("simple_return", F.try_divide(F.col(column), lagged(column)) - 1))


def sma(bars: DataFrame, grid: Grid, period: int, column: str = "close") -> DataFrame:
    df = frame(bars, grid, positive_period(period))
    return owned(df.withColumn("sma", warm(period - 1, F.avg(column).over(over(period)))))


def ema(bars: DataFrame, grid: Grid, period: int, column: str = "close") -> DataFrame:
    positive_period(period)
    df = frame(bars, grid, memory_rows(ema_decay(period)))
    return owned(affine_scan(df, KEYS, "ts", {"ema": ema_forcing(F.col(column), period)}))


def rolling_volatility(bars: DataFrame, grid: Grid, period: int) -> DataFrame:
    df = frame(bars, grid, positive_period(period, 2) + 1)
    df = df.withColumn("_ret", F.try_divide(F.col("close"), lagged("close")) - 1)
    return owned(
        df.withColumn("rolling_volatility", warm(period, F.stddev_samp("_ret").over(over(period))))
    )


def rsi(bars: DataFrame, grid: Grid, period: int = 14) -> DataFrame:
    positive_period(period)
    df = with_moves(frame(bars, grid, memory_rows(wilder_decay(period)) + period + 1), period)
    df = affine_scan(df, KEYS, "ts", move_terms(period))
    return owned(with_carried_rsi(rsi_from_moves(df, period).filter("_own"), "rsi", period))


def atr(bars: DataFrame, grid: Grid, period: int = 14) -> DataFrame:
    positive_period(period)
    df = frame(bars, grid, memory_rows(wilder_decay(period)) + period + 1)
    df = df.withColumn("_tr", true_range(lagged("close")))
    df = df.withColumn("_tr_mean", F.avg("_tr").over(over(period)))
    term = wilder_forcing(F.col("_tr"), F.col("_tr_mean"), period - 1, period)
    df = affine_scan(df, KEYS, "ts", {"_atr": term})
    return owned(df.withColumn("atr", warm(period - 1, F.col("_atr"))))


def volume_ratio(bars: DataFrame, grid: Grid, period: int) -> DataFrame:
    df = frame(bars, grid, positive_period(period))
    baseline = F.avg("volume").over(over(first=-period, last=-1))
    return owned(
        df.withColumn(
            "volume_ratio", warm(period, F.try_divide(F.col("volume"), baseline))
        )
    )
