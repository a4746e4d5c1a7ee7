"""The forty causal features of a bar, as columns over one blocked sort per instrument."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.indicators import (
    KEYS,
    ema_decay,
    ema_forcing,
    frame,
    lagged,
    move_terms,
    over,
    rsi_from_moves,
    with_carried_rsi,
    true_range,
    warm,
    wilder_decay,
    wilder_forcing,
    with_moves,
)
from tapeworks.functions.series import BLOCK, OWN, Grid, affine_scan, memory_rows

FEATURE_VERSION = "research-v1"

FEATURES = [
    *[f"return_{n}" for n in (1, 5, 10, 20)],
    *[f"log_return_{n}" for n in (1, 5, 10, 20)],
    "volume_zscore_20", "volume_acceleration", "bollinger_position", "open_interest",
    *[f"sma_{n}" for n in (5, 10, 20, 50)],
    "ema_12", "ema_26", "rsi_14", "macd", "macd_signal", "macd_histogram",
    "atr_14", "atr_pct", "bollinger_upper", "bollinger_lower",
    "realized_volatility_20", "high_low_volatility_20", "volume_ratio_20", "zscore_20",
    "return_acceleration", "ma_distance_20", "momentum_20", "rolling_high_20", "rolling_low_20",
    "oi_change", "price_oi_relationship", "basis", "time_to_expiry_days", "moneyness",
]

LINEAGE = ["provenance", "dataset_version", "synthetic"]


def _nonzero(value: Column) -> Column:
    return F.when(value != 0, value)


def _trailing(df: DataFrame) -> DataFrame:
    """Everything that needs only bounded trailing frames."""
    close, volume = F.col("close"), F.col("volume")
    df = df.withColumns(
        {
            **{f"_c{n}": lagged("close", n) for n in (1, 2, 5, 10, 20)},
            "_v1": lagged("volume", 1),
            "_v2": lagged("volume", 2),
            "_oi1": lagged("open_interest", 1),
            **{f"sma_{n}": warm(n - 1, F.avg("close").over(over(n))) for n in (5, 10, 20, 50)},
            "_sd": warm(19, F.stddev_samp("close").over(over(20))),
            "_vm": warm(19, F.avg("volume").over(over(20))),
            "_vsd": warm(19, F.stddev_samp("volume").over(over(20))),
            "_vprev": warm(20, F.avg("volume").over(over(first=-20, last=-1))),
            "_hl": warm(
                19, F.avg(F.pow(F.log(F.try_divide(F.col("high"), F.col("low"))), F.lit(2))).over(over(20))
            ),
            "rolling_high_20": warm(19, F.max("high").over(over(20))),
            "rolling_low_20": warm(19, F.min("low").over(over(20))),
        }
    )
    df = df.withColumns(
        {"_lr": F.log(F.try_divide(close, F.col("_c1"))), "_tr": true_range(F.col("_c1"))}
    ).withColumns(
        {
            "realized_volatility_20": warm(20, F.stddev_samp("_lr").over(over(20))),
            "_tr_mean": F.avg("_tr").over(over(14)),
        }
    )
    avg, sd = F.col("sma_20"), F.col("_sd")
    underlying, strike = F.col("underlying_price"), F.col("strike")
    oi_change = F.col("open_interest") - F.col("_oi1")
    return df.withColumns(
        {
            **{f"return_{n}": F.try_divide(close, F.col(f"_c{n}")) - 1 for n in (1, 5, 10, 20)},
            **{
                f"log_return_{n}": F.log(F.try_divide(close, F.col(f"_c{n}")))
                for n in (1, 5, 10, 20)
            },
            "volume_zscore_20": F.try_divide(volume - F.col("_vm"), _nonzero(F.col("_vsd"))),
            "volume_acceleration": volume - F.lit(2.0) * F.col("_v1") + F.col("_v2"),
            "bollinger_position": F.try_divide(close - (avg - 2 * sd), _nonzero(4 * sd)),
            "bollinger_upper": avg + 2 * sd,
            "bollinger_lower": avg - 2 * sd,
            "high_low_volatility_20": F.sqrt(F.col("_hl") / F.lit(4 * math.log(2))),
            "volume_ratio_20": F.try_divide(volume, _nonzero(F.col("_vprev"))),
            "zscore_20": F.try_divide(close - avg, _nonzero(sd)),
            "return_acceleration": F.try_divide(close, F.col("_c1"))
            - F.try_divide(F.col("_c1"), F.col("_c2")),
            "ma_distance_20": F.try_divide(close, avg) - 1,
            "momentum_20": close - F.col("_c20"),
            "oi_change": oi_change,
            "price_oi_relationship": (close - F.col("_c1")) * oi_change,
            "basis": F.try_divide(close, underlying) - 1,
            "time_to_expiry_days": (F.unix_micros("expiry") - F.unix_micros("ts"))
            / F.lit(86400e6),
            "moneyness": F.try_divide(underlying, strike),
        }
    )


def _recursive(df: DataFrame) -> DataFrame:
    """EMA, MACD, RSI and ATR by affine scans."""
    df = with_moves(df, 14)
    close = F.col("close")
    df = affine_scan(
        df,
        KEYS,
        "ts",
        {
            "ema_12": ema_forcing(close, 12),
            "ema_26": ema_forcing(close, 26),
            "_atr": wilder_forcing(F.col("_tr"), F.col("_tr_mean"), 13, 14),
            **move_terms(14),
        },
    )
    df = rsi_from_moves(df.withColumn("macd", F.col("ema_12") - F.col("ema_26")), 14)
    df = affine_scan(df, KEYS, "ts", {"macd_signal": ema_forcing(F.col("macd"), 9)})
    return df.withColumns(
        {
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
            "atr_14": warm(13, F.col("_atr")),
            "atr_pct": warm(13, F.try_divide(F.col("_atr"), close)),
        }
    )


def _uncarried(bars: DataFrame, grid: Grid, after: int) -> DataFrame:
    # The MACD signal remembers on top of what the averages under it remember.
    slowest = max(ema_decay(26), wilder_decay(14))
    before = memory_rows(slowest) + memory_rows(ema_decay(9)) + 50
    return _recursive(_trailing(frame(bars, grid, before, after)))


def feature_frame(bars: DataFrame, grid: Grid, *, after: int = 0) -> DataFrame:
    """Features with the block helpers still attached, for operators that add to the frame."""
    return with_carried_rsi(_uncarried(bars, grid, after), "rsi_14", 14)


def build_features(bars: DataFrame, grid: Grid) -> DataFrame:
    named = ["instrument_id", "ts", *[c for c in LINEAGE if c in bars.columns]]
    plain = [c for c in FEATURES if c != "rsi_14"]
    own = _uncarried(bars, grid, 0).filter(OWN).select(*named, *plain, BLOCK, OWN, "_idx", "_rsi_at", "_rsi_here")
    rows = with_carried_rsi(own, "rsi_14", 14)
    return rows.select(*named[:2], F.lit(FEATURE_VERSION).alias("feature_version"), *named[2:], *FEATURES)


def feature_map(features: DataFrame) -> DataFrame:
    """Export form: one map of feature name to value per row."""
    pairs = [item for name in FEATURES for item in (F.lit(name), F.col(name))]
    kept = [c for c in features.columns if c not in FEATURES]
    return features.select(*kept, F.create_map(*pairs).alias("values"))
