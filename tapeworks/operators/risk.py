"""Pre-trade risk screen: a pure function of order, quote, account snapshot and policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.cells import failed, local_date, local_seconds, local_time
from tapeworks.functions.series import salted_lookup


@dataclass(frozen=True)
class Policy:
    """Limits of the screen; the defaults are the published paper-trading ones."""

    initial_cash: str = "100000"
    max_capital_per_trade: str = "10000"
    max_portfolio_exposure: str = "50000"
    max_open_positions: int = 5
    max_daily_loss: str = "5000"
    allowed_symbols: frozenset[str] = frozenset({"DEMO"})
    allowed_instrument_types: frozenset[str] = frozenset({"equity"})
    quote_max_age_seconds: int = 30
    mandatory_stop_loss: bool = True
    market_open: str = "09:15"
    market_close: str = "15:30"
    holidays: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if _seconds(self.market_open) >= _seconds(self.market_close):
            raise ValueError("market_open must precede market_close")
        if self.max_open_positions < 1 or self.quote_max_age_seconds < 1:
            raise ValueError("limits must be positive")


def _seconds(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 3600 + int(minutes) * 60


def market_closed(policy: Policy, now: Column) -> Column:
    second = local_seconds(now)
    closed = (
        (F.weekday(local_time(now)) >= 5)
        | (second < _seconds(policy.market_open))
        | (second >= _seconds(policy.market_close))
    )
    if policy.holidays:
        closed = closed | local_date(now).cast("string").isin(*sorted(policy.holidays))
    return closed


def quote_checks(policy: Policy) -> dict[str, Column]:
    c = F.col
    age = (F.unix_micros("now") - F.unix_micros("quote_ts")) / F.lit(1e6)
    return {
        "quote_mismatch": ~(
            c("quote_symbol").eqNullSafe(c("symbol"))
            & c("quote_type").eqNullSafe(c("instrument_type"))
        ),
        "future_quote": age < 0,
        "stale_quote": age > policy.quote_max_age_seconds,
    }


def limit_checks(policy: Policy, price: Column, quantity: Column) -> dict[str, Column]:
    """Cash, exposure, loss, position and stop checks for one price."""
    c = F.col
    amount = (price * quantity.cast("decimal(12,0)")).cast("decimal(26,4)")
    money = lambda text: F.lit(text).cast("decimal(18,4)")
    buying, held = c("side") == "buy", c("held_quantity")
    stop = c("stop_loss")
    wrong_stop = stop.isNotNull() & ~F.when(buying, (stop > 0) & (stop < price)).otherwise(
        stop > price
    )
    if policy.mandatory_stop_loss:
        wrong_stop = stop.isNull() | wrong_stop
    return {
        "capital_per_trade": amount > money(policy.max_capital_per_trade),
        "daily_loss": (c("equity") - c("day_start_equity")) <= -money(policy.max_daily_loss),
        "insufficient_cash": buying & (amount > c("cash")),
        "portfolio_exposure": buying
        & (c("exposure") + amount > money(policy.max_portfolio_exposure)),
        "open_positions": buying
        & held.isNull()
        & (c("open_positions") >= policy.max_open_positions),
        "insufficient_position": ~buying & (held.isNull() | (quantity > held)),
        "invalid_stop_loss": wrong_stop,
    }


def mark_repeats(orders: DataFrame, order: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """Adds ``repeated``: the id was used by an earlier order, or is in the history ``seen``.

    The first use of every repeated id is found by a partial aggregate; the lookup is salted,
    so one id with very many copies does not land in one task.
    """
    here = F.struct(*order)
    firsts = (
        orders.groupBy("client_order_id")
        .agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    df = salted_lookup(orders, firsts, ["client_order_id"])
    repeated = F.col("_first").isNotNull() & (here != F.col("_first"))
    if seen is not None:
        known = seen.select("client_order_id").distinct().withColumn("_known", F.lit(True))
        df = salted_lookup(df, known, ["client_order_id"])
        repeated = repeated | F.col("_known").isNotNull()
    return df.withColumn("repeated", F.coalesce(repeated, F.lit(False))).drop("_first", "_known")


def allowlist(policy: Policy) -> dict[str, Column]:
    return {
        "symbol_not_allowed": ~F.col("symbol").isin(*sorted(policy.allowed_symbols)),
        "instrument_type_not_allowed": ~F.col("instrument_type").isin(
            *sorted(policy.allowed_instrument_types)
        ),
    }


def screen(
    rows: DataFrame, policy: Policy, price: str = "quote_price", quantity: str = "quantity"
) -> Column:
    """Reasons of every failed check, in policy order.

    ``rows`` is an order joined to its quote (``quote_symbol``, ``quote_type``, ``quote_ts``,
    price), account snapshot (``cash``, ``equity``, ``exposure``, ``day_start_equity``,
    ``open_positions``), position (``held_quantity``, null when none), ``repeated`` and ``now``.
    """
    checks = {
        "market_closed": market_closed(policy, F.col("now")),
        "duplicate_order": F.col("repeated"),
        **allowlist(policy),
        **quote_checks(policy),
        **limit_checks(policy, F.col(price), F.col(quantity)),
    }
    return failed(checks)


def risk_screen(rows: DataFrame, policy: Policy) -> DataFrame:
    df = rows.select("*", F.explode(F.array(screen(rows, policy))).alias("reasons"))
    return df.withColumn("approved", F.size("reasons") == 0)


def two_price_screen(rows: DataFrame, policy: Policy, fill_price: str = "fill_price") -> DataFrame:
    """The same screen at the observed open and at the slipped price, reasons merged."""
    both = F.array_union(screen(rows, policy), screen(rows, policy, price=fill_price))
    df = rows.select("*", F.explode(F.array(both)).alias("reasons"))
    return df.withColumn("approved", F.size("reasons") == 0)


def with_positions(orders: DataFrame, snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    """Order with its account snapshot and the held quantity of its symbol."""
    held = positions.select("account", "symbol", F.col("quantity").alias("held_quantity"))
    return orders.join(snapshots, "account", "left").join(held, ["account", "symbol"], "left")


def cash_after_costs(price: Column, quantity: Column, cost: Column) -> Column:
    """Cash the fill needs, fees included; sells need only what fees exceed proceeds by."""
    value = (price * quantity.cast("decimal(12,0)")).cast("decimal(26,4)")
    return F.when(F.col("side") == "buy", value + cost).otherwise(cost - value)


def risk_status(snapshots: DataFrame, policy: Policy) -> DataFrame:
    pnl = F.col("equity") - F.col("day_start_equity")
    money = lambda text: F.lit(text).cast("decimal(18,4)")
    return snapshots.select(
        "account",
        F.lit("paper").alias("execution_mode"),
        pnl.alias("daily_pnl"),
        (pnl <= -money(policy.max_daily_loss)).alias("daily_loss_blocked"),
        money(policy.max_daily_loss).alias("max_daily_loss"),
        money(policy.max_capital_per_trade).alias("max_capital_per_trade"),
        money(policy.max_portfolio_exposure).alias("max_portfolio_exposure"),
        F.lit(policy.max_open_positions).alias("max_open_positions"),
        F.lit(",".join(sorted(policy.allowed_symbols))).alias("allowed_symbols"),
        F.lit(",".join(sorted(policy.allowed_instrument_types))).alias("allowed_instrument_types"),
        F.lit(policy.mandatory_stop_loss).alias("mandatory_stop_loss"),
        F.lit(policy.quote_max_age_seconds).alias("quote_max_age_seconds"),
    )
