"""Calendar joins, contract joins and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.blocks import bounded_buckets
from tapeworks.functions.cells import local_date
from tapeworks.functions.series import Grid, running
from tapeworks.schemas import CONTRACTS


def session_join(rows: DataFrame, sessions: DataFrame, bar_seconds: int) -> DataFrame:
    """Adds ``in_session`` (close inside, both ends included) and ``executable`` (the whole
    bar, open to close, inside one session). Days without a session are closed."""
    calendar = sessions.select(F.col("session_date").alias("_day"), "opens_at", "closes_at")
    opened = F.timestamp_micros(F.unix_micros("ts") - F.lit(bar_seconds * 1_000_000))
    df = rows.withColumn("_day", local_date(F.col("ts"))).join(calendar, "_day", "left")
    inside = F.col("ts").between(F.col("opens_at"), F.col("closes_at"))
    whole = (
        (opened >= F.col("opens_at"))
        & (opened <= F.col("closes_at"))
        & (F.col("ts") <= F.col("closes_at"))
    )
    return df.withColumns(
        {
            "in_session": F.coalesce(inside, F.lit(False)),
            "executable": F.coalesce(whole, F.lit(False)),
        }
    ).drop("_day")


def not_on_holiday(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    closed = holidays.select(F.col("holiday").alias("_day"))
    return rows.withColumn("_day", local_date(F.col("ts"))).join(closed, "_day", "left_anti").drop("_day")


def contract_join(bars: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract of each bar: its own reference when it has one, else the master's."""
    master = contracts.select("symbol", F.struct(*CONTRACTS.fieldNames()).alias("_master"))
    df = bars.join(master, "symbol", "left")
    own = F.col("contract") if "contract" in bars.columns else F.lit(None)
    return df.withColumn("contract", F.coalesce(own, F.col("_master"))).drop("_master")


def next_after(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    grid: Grid,
    *,
    prefix: str = "next_",
) -> DataFrame:
    """Forward as-of: for each left row the first right row of its key strictly later.

    Both sides are put on one timeline and scanned in blocks of counted size with a carry from later
    blocks, so neither a range join nor a whole key in one task is needed. On equal times the
    right row comes first, so it is not taken.
    """
    return _asof(left, right, keys, columns, grid, prefix, "next", left_rank=1)


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    grid: Grid,
    *,
    prefix: str = "last_",
) -> DataFrame:
    """Backward as-of: the last right row of the key at or before the left row."""
    return _asof(left, right, keys, columns, grid, prefix, "last", left_rank=1)


def _asof(left, right, keys, columns, grid, prefix, kind, left_rank) -> DataFrame:
    payload = F.struct("ts", *columns)
    events = right.select(*keys, "ts", payload.alias("_hit"), F.lit(0).alias("_side"))
    packed = left.select(
        *keys, "ts", F.struct(*left.columns).alias("_row"), F.lit(left_rank).alias("_side")
    )
    timeline = packed.unionByName(events, allowMissingColumns=True)
    # Orders may crowd at one time, so pieces follow from counted rows, and equal times are parted too.
    tie = F.xxhash64("_row", "_hit")
    timeline, bucket = bounded_buckets(timeline, keys, ["ts", "_side"], grid.bucket("ts"), tie=tie)
    scanned = running(timeline, keys, ["ts", "_side"], bucket, {"_found": (kind, F.col("_hit"))})
    found = scanned.filter(F.col("_side") == left_rank)
    return found.select(
        "_row.*",
        F.col("_found.ts").alias(f"{prefix}ts"),
        *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns],
    )
