"""Performance metrics per run. Undefined ratios are null."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.cells import failed
from tapeworks.functions.series import Grid, block_window, owned, running, split_series

KEY = "run_id"


def equity_guards(equity: DataFrame, grid: Grid) -> DataFrame:
    """Per run: reasons why its equity series cannot be measured."""
    df = _with_previous(equity, grid)
    value, before = F.col("equity"), F.col("previous")
    facts = df.groupBy(KEY).agg(
        F.min_by("equity", "ts").alias("first"),
        F.min("equity").alias("lowest"),
        F.count_if(value.isNull()).alias("missing"),
        F.count_if((before == 0) & (value > 0)).alias("recoveries"),
        F.count_if(before == 0).alias("zero_starts"),
    )
    reasons = failed(
        {
            "nonpositive_start": F.col("first") <= 0,
            "negative_or_missing_equity": (F.col("lowest") < 0) | (F.col("missing") > 0),
            "recovers_from_zero": F.col("recoveries") > 0,
        }
    )
    return facts.withColumn("reasons", reasons).withColumn(
        "returns_defined", F.col("zero_starts") == 0
    )


def _with_previous(equity: DataFrame, grid: Grid) -> DataFrame:
    cut = split_series(equity, [KEY], grid.bucket("ts"), before=1, block_rows=grid.block_rows)
    return owned(cut.withColumn("previous", F.lag("equity").over(block_window([KEY], "ts"))))


def drawdown(equity: DataFrame, grid: Grid) -> DataFrame:
    """Largest fall from the running peak, per run."""
    peaks = running(equity, [KEY], ["ts"], grid.bucket("ts"), {"peak": ("max", F.col("equity"))})
    fall = 1 - F.try_divide(F.col("equity").cast("double"), F.col("peak").cast("double"))
    return peaks.groupBy(KEY).agg(F.max(fall).alias("max_drawdown"))


def metrics(
    equity: DataFrame, grid: Grid, periods_per_year: int = 252, risk_free_rate: float = 0.0
) -> DataFrame:
    if periods_per_year <= 0 or not math.isfinite(risk_free_rate) or risk_free_rate <= -1:
        raise ValueError("invalid annualization assumptions")
    per = F.lit(float(periods_per_year))
    rf = (1 + risk_free_rate) ** (1 / periods_per_year) - 1
    df = _with_previous(equity, grid)
    value, before = F.col("equity").cast("double"), F.col("previous").cast("double")
    ret = F.try_divide(value, before) - 1
    excess = ret - F.lit(rf)
    base = df.groupBy(KEY).agg(
        F.min_by("equity", "ts").cast("double").alias("_first"),
        F.max_by("equity", "ts").cast("double").alias("_last"),
        F.count_if(before == 0).alias("_zeros"),
        F.count(ret).alias("_n"),
        F.stddev_samp(ret).alias("_sd"),
        F.avg(excess).alias("_mean"),
        F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2))).alias("_down"),
    )
    c = F.col
    usable = c("_zeros") == 0  # one zero start leaves no defined return series
    base = base.withColumns(
        {
            "total_return": F.try_divide(c("_last"), c("_first")) - 1,
            "_n": F.when(usable, c("_n")).otherwise(0),
            "_mean": F.when(usable, c("_mean")),
            "_down": F.when(usable, F.sqrt("_down")),
            "annualized_volatility": F.when(usable & (c("_n") > 1), c("_sd") * F.sqrt(per)),
        }
    )
    base = base.withColumn(
        "annualized_return",
        F.when(c("_n") >= per, F.pow(1 + c("total_return"), F.try_divide(per, c("_n"))) - 1),
    ).join(drawdown(equity, grid), KEY)
    nonzero = lambda n: F.when(c(n) != 0, c(n))
    return base.select(
        KEY,
        "total_return",
        "annualized_return",
        "annualized_volatility",
        F.try_divide(c("_mean") * per, nonzero("annualized_volatility")).alias("sharpe"),
        F.try_divide(c("_mean") * F.sqrt(per), nonzero("_down")).alias("sortino"),
        "max_drawdown",
        F.try_divide(c("annualized_return"), nonzero("max_drawdown")).alias("calmar"),
    )


def trade_metrics(trades: DataFrame, key: str = KEY, pnl: str = "realized_pnl") -> DataFrame:
    """Win/loss statistics over closing fills."""
    p = F.col(pnl).cast("double")
    n = F.count(p)
    wins, losses = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, p))
    return trades.groupBy(key).agg(
        F.try_divide(F.count_if(p > 0), n).alias("win_rate"),
        F.try_divide(F.count_if(p < 0), n).alias("loss_rate"),
        F.when(
            F.count_if(p < 0) > 0, F.try_divide(F.coalesce(wins, F.lit(0.0)), -losses)
        ).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("average_win"),
        F.avg(F.when(p < 0, p)).alias("average_loss"),
        F.avg(p).alias("expectancy"),
        n.alias("closed_trade_count"),
    )


def activity(
    fills: DataFrame, exposures: DataFrame, initial: float, key: str = "account"
) -> DataFrame:
    """Turnover, costs, slippage and fill count, with the mean exposure over the curve."""
    value = (F.col("price") * F.col("quantity").cast("decimal(12,0)")).cast("decimal(26,4)")
    traded = fills.groupBy(key).agg(
        (F.sum(value).cast("double") / F.lit(float(initial))).alias("turnover"),
        F.sum("cost").cast("double").alias("costs"),
        F.sum("slippage_cost").cast("double").alias("slippage"),
        F.count(F.lit(1)).alias("fill_count"),
    )
    mean = exposures.groupBy(key).agg(F.avg(F.col("exposure").cast("double")).alias("_mean"))
    return (
        traded.join(mean, key, "full")
        .withColumn("average_exposure", F.coalesce("_mean", F.lit(0.0)))
        .drop("_mean")
    )


def long_report(wide: DataFrame, key: str = KEY) -> DataFrame:
    """(key, metric, value) rows of a metric table."""
    names = [c for c in wide.columns if c != key]
    typed = wide.select(key, *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot([key], names, "metric", "value")
