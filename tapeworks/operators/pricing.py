"""Order pricing: next-open execution, costs, slippage, ticks, limits and liquidity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.blocks import BITS, bounded_buckets
from tapeworks.functions.cells import failed
from tapeworks.functions.indicators import frame, lagged
from tapeworks.functions.series import BLOCK, Grid, owned, running
from tapeworks.functions.shift_maps import DELTA, MOST, START, accept_in_order
from tapeworks.operators.sessions import next_after
from tapeworks.session import staged

MONEY = "decimal(18,4)"
RATE = "decimal(9,8)"
FEES = ["brokerage", "stt", "exchange", "sebi", "stamp"]
GST_FEES = ["brokerage", "exchange", "sebi"]


# --- next open ---------------------------------------------------------------------------


def prior_bars(bars: DataFrame, grid: Grid) -> DataFrame:
    """Each bar with what was known before it opened: prior volume and absolute move."""
    df = frame(bars, grid, 3)
    df = df.withColumns(
        {"prior_volume": lagged("volume"), "_p1": lagged("close"), "_p2": lagged("close", 2)}
    )
    money = lambda n: F.col(n).cast(MONEY)
    move = (F.try_divide(money("_p1"), money("_p2")) - 1).cast("decimal(18,12)")
    return owned(
        df.withColumns(
            {
                "prior_volume": F.coalesce("prior_volume", F.lit(0).cast("bigint")),
                "volatility": F.coalesce(F.abs(move), F.lit(0).cast("decimal(18,12)")),
            }
        )
    )


def next_open(orders: DataFrame, bars: DataFrame, grid: Grid) -> DataFrame:
    """Price every order at the open of the first bar of its instrument after the signal.

    ``next_open`` is null for the last signal of an instrument, which stays unfilled.
    """
    columns = [c for c in ("open", "volume", "prior_volume", "volatility") if c in bars.columns]
    priced = next_after(orders, bars, ["instrument_id"], columns, grid)
    opened = F.timestamp_micros(F.unix_micros("next_ts") - F.lit(grid.bar_seconds * 1_000_000))
    return priced.withColumn("executed_at", opened).withColumn(
        "unfilled_reason", F.when(F.col("next_ts").isNull(), "no_next_bar")
    )


# --- costs and slippage ------------------------------------------------------------------


def schedule_row(product: str, gst_rate: str = "0", gst: Sequence[str] = GST_FEES, **fees) -> tuple:
    """One product of a cost schedule; each fee is (buy rate, sell rate, cap or None)."""
    if set(fees) - set(FEES) or set(gst) - set(GST_FEES):
        raise ValueError("unknown cost component")
    values: list = [product]
    for name in FEES:
        buy, sell, cap = fees.get(name, ("0", "0", None))
        values += [buy, sell, cap]
    return (*values, gst_rate, list(gst))


def cost_schedules(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Small dimension: one row per product."""
    names = [f"{n}_{k}" for n in FEES for k in ("buy", "sell", "cap")]
    schema = "product string, " + ", ".join(f"{n} string" for n in names)
    raw = spark.createDataFrame(list(rows), f"{schema}, gst_rate string, gst array<string>")
    return raw.select(
        "product",
        *[F.col(n).cast(MONEY if n.endswith("cap") else RATE).alias(n) for n in names],
        F.col("gst_rate").cast(RATE).alias("gst_rate"),
        F.array_distinct("gst").alias("gst"),
    )


def with_costs(orders: DataFrame, schedules: DataFrame, price: str = "price") -> DataFrame:
    """Fee breakdown per order. An unknown product has no fees and a reason.

    The schedule has one row per product, so it is broadcast.
    """
    df = orders.join(F.broadcast(schedules), "product", "left")
    turnover = (F.col(price) * F.col("quantity").cast("decimal(12,0)")).cast("decimal(24,4)")
    buying = F.col("side") == "buy"
    amounts = {}
    for name in FEES:
        rate = F.when(buying, F.col(f"{name}_buy")).otherwise(F.col(f"{name}_sell"))
        value = (turnover * rate).cast("decimal(30,10)")
        capped = F.when(F.col(f"{name}_cap").isNotNull(), F.least(value, F.col(f"{name}_cap")))
        fee = F.coalesce(capped, value, F.lit(0)).cast("decimal(28,10)")
        amounts[name] = fee
    df = df.withColumns(amounts)
    base = F.lit(0).cast("decimal(28,10)")
    for name in GST_FEES:
        base = base + F.when(F.array_contains("gst", name), F.col(name)).otherwise(F.lit(0))
    gst = F.coalesce(base.cast("decimal(20,10)") * F.col("gst_rate"), F.lit(0))
    df = df.withColumn("gst_fee", gst.cast("decimal(28,10)"))
    total = F.col("gst_fee")
    for name in FEES:
        total = total + F.col(name)
    helpers = [f"{n}_{k}" for n in FEES for k in ("buy", "sell", "cap")] + ["gst_rate", "gst"]
    missing = F.when(F.col("gst_rate").isNull(), "missing_cost_schedule")
    return (
        df.withColumn("total_cost", total.cast("decimal(28,10)"))
        .withColumn("cost_reason", missing)
        .drop(*helpers)
    )


@dataclass(frozen=True)
class Slippage:
    """Decimal texts; the price moves by bps/10000 + percentage + multiplier * volatility."""

    bps: str = "0"
    percentage: str = "0"
    volatility_multiplier: str = "0"

    def price(self, price: Column, side: Column, volatility: Column) -> Column:
        """DECIMAL(18,4) times a factor of sixteen decimals, which fits without rounding."""
        fixed = Decimal(self.bps) / 10000 + Decimal(self.percentage)
        moving = volatility.cast("decimal(18,12)") * F.lit(self.volatility_multiplier).cast(
            "decimal(8,4)"
        )
        fraction = F.lit(str(fixed)).cast("decimal(18,16)") + moving
        one = F.lit("1").cast("decimal(1,0)")
        factor = F.when(side == "buy", one + fraction).otherwise(one - fraction)
        return price.cast(MONEY) * factor.cast("decimal(19,16)")


def to_tick(value: Column, tick: Column, side: Column) -> Column:
    """Adverse rounding in decimals: up for buys, down for sells; null for a tick of zero."""
    steps = F.try_divide(value, tick.cast("decimal(10,4)"))
    whole = F.when(side == "buy", F.ceil(steps)).otherwise(F.floor(steps))
    return (whole.cast("decimal(20,0)") * tick.cast("decimal(10,4)")).cast(MONEY)


def slipped_fill(orders: DataFrame, slippage: Slippage, tick: Column) -> DataFrame:
    """``fill_price`` after slippage and tick rounding; the open when that is not positive or the tick is
    none."""
    side, opened = F.col("side"), F.col("open")
    raw = slippage.price(opened, side, F.col("volatility"))
    rounded = to_tick(raw, tick, side)
    untold = F.coalesce(tick <= 0, F.lit(True))
    bad = (raw <= 0) | (rounded <= 0)
    reason = F.when(untold, "invalid_tick").when(bad, "invalid_slippage_price")
    df = orders.withColumn("slippage_reason", reason)
    price = F.when(untold | bad, opened).otherwise(rounded).cast(MONEY)
    return df.withColumn("fill_price", price).withColumn(
        "slippage_cost",
        (F.abs(F.col("fill_price") - opened) * F.col("quantity").cast("decimal(12,0)")).cast(
            "decimal(24,4)"
        ),
    )


def limit_reasons(tick: Column) -> Column:
    """Limit orders must sit on a tick and be marketable at the rounded fill price."""
    limit, price, side = F.col("limit_price"), F.col("fill_price"), F.col("side")
    away = ((side == "buy") & (price > limit)) | ((side == "sell") & (price < limit))
    return failed(
        {"invalid_limit_tick": F.coalesce(F.try_mod(limit, tick) != 0, limit.isNotNull()), "limit_not_marketable_at_open": away}
    )


def eligibility_reasons() -> Column:
    """Instrument, contract, product and lot checks on an order joined to its bar."""
    c = F.col
    equity = c("asset_class") == "equity"
    ref = lambda n: c(f"contract.{n}")
    has = ref("contract_id").isNotNull()
    kind = F.when(ref("instrument_type").startswith("OPT"), "option").otherwise("future")
    expected = F.when(c("asset_class") == "future", "future").otherwise("option")
    same = kind.eqNullSafe(expected)
    for name in ("symbol", "expiry", "underlying", "strike", "option_type", "exchange"):
        same = same & ref(name).eqNullSafe(c(name))
    wrong_product = F.when(
        equity, ~c("product").isin("equity_delivery", "equity_intraday")
    ).otherwise(c("product") != c("asset_class"))
    checks = {
        "instrument_mismatch": (c("exchange") != "NSE")
        | (c("instrument_type") != c("asset_class")),
        "missing_contract": ~equity & ~has,
        "contract_mismatch": ~equity & has & ~same,
        "cost_product_mismatch": wrong_product,
        "invalid_lot_quantity": has & F.coalesce(F.try_mod(c("quantity"), ref("lot_size")) != 0, F.lit(True)),
    }
    return failed(checks)


# --- liquidity ---------------------------------------------------------------------------

GROUP = ["instrument_id", "executed_at"]


def partial_fills(orders: DataFrame, grid: Grid, fraction: str | float = "1") -> DataFrame:
    """Fill at most the wanted fraction and what is left of the prior volume, in whole lots.

    Wanted sizes are multiples of the lot, so what earlier orders took is a prefix sum. The fraction is
    a decimal as written: 0.29 of 100 is 29. A lot of zero fills nothing.
    """
    if not 0 < float(fraction) <= 1:
        raise ValueError(f"no fraction of an order: {fraction!r}")
    lot = F.col("lot_size")
    share = F.lit(str(fraction)).cast("decimal(18,12)")
    wanted = F.floor(F.col("quantity").cast("decimal(19,0)") * share).cast("bigint")
    wanted = F.coalesce(wanted - F.try_mod(wanted, lot), F.lit(0))
    room = F.coalesce(F.col("capacity") - F.try_mod(F.col("capacity"), lot), F.lit(0))
    df = orders.withColumns({"_want": F.when(F.col("eligible"), wanted).otherwise(0), "_room": room})
    df, bucket = bounded_buckets(staged(df, "orders"), GROUP, ["arrival"], F.lit(0))
    df = running(df, GROUP, ["arrival"], bucket, {"_taken": ("sum", F.col("_want"))}, include_current=False)
    left = F.greatest(F.col("_room") - F.coalesce("_taken", F.lit(0)), F.lit(0))
    filled = F.least("_want", left).cast("bigint")
    df = df.withColumn("filled_quantity", filled)
    reason = F.when(F.col("eligible") & (F.col("filled_quantity") <= 0), "no_fill_quantity")
    return df.withColumn("liquidity_reason", reason).drop("_want", "_room", "_taken", BLOCK)


def rejected_fills(orders: DataFrame) -> DataFrame:
    """The mode in which nothing is filled: every eligible order is refused with its own reason."""
    return orders.withColumns(
        {
            "accepted": F.lit(False),
            "liquidity_reason": F.when(F.col("eligible"), "fill_model_reject"),
        }
    )


def full_fills(orders: DataFrame, grid: Grid | None = None, *, bits: int = BITS) -> DataFrame:
    """All-or-nothing fills against the prior volume, in arrival order.

    A rejected order takes nothing, so each decision depends on the ones before it. Three
    exact reductions leave little for the ordered pass: an order above the capacity is
    rejected outright; a group whose total fits is accepted whole; and orders whose running
    total still fits are accepted by prefix sum. What follows the first overflow of a contested
    group is settled in blocks, by maps from the room left before a block to what it leaves.
    """
    df = orders.withColumn(
        "_ask", F.when(F.col("eligible") & (F.col("quantity") <= F.col("capacity")), F.col("quantity"))
    )
    # A group in one piece, unless it is large: arrivals may lie so far apart that any bucket holds but a row.
    df, bucket = bounded_buckets(staged(df, "orders"), GROUP, ["arrival"], F.lit(0), bits=bits)
    df = running(df, GROUP, ["arrival"], bucket, {"_upto": ("sum", F.col("_ask"))})
    df = staged(df.drop(BLOCK), "asks")
    asks = F.col("_ask").isNotNull()
    fits = asks & (F.col("_upto") <= F.col("capacity"))
    overflow = (
        df.filter(asks)
        .groupBy(*GROUP)
        .agg(F.min(F.when(~fits, F.col("arrival"))).alias("_over"), F.max(F.when(fits, F.col("_upto"))).alias("_spent"))
    )
    df = df.join(overflow.filter("_over IS NOT NULL"), GROUP, "left")
    before = F.col("_over").isNull() | (F.col("arrival") < F.col("_over"))
    left = F.col("capacity") - F.coalesce("_spent", F.lit(0))
    # What can't fit in the room that is left is rejected before the ordered pass.
    hopeless = ~before & asks & (F.col("_ask") > left)
    settled = df.filter(before | ~asks | hopeless).withColumn("accepted", fits & ~hopeless)
    contested = df.filter(~before & asks & (F.col("_ask") <= left))
    contested = contested.withColumns({DELTA: (-F.col("_ask")).cast("long"), START: left.cast("long"), MOST: left.cast("long")})
    taken = accept_in_order(contested, GROUP, ["arrival"], bits=bits)
    done = settled.unionByName(taken.select(*settled.columns))
    reason = F.when(F.col("eligible") & ~F.col("accepted"), "partial_fill_unsupported")
    return done.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn(
        "liquidity_reason", reason
    ).drop("_ask", "_upto", "_over", "_spent")


def fill_status(orders: DataFrame) -> DataFrame:
    """filled / partially_filled / rejected / unfilled, with each reason once, in order."""
    reasons = F.array_distinct("reasons")
    status = (
        F.when(F.col("executed_at").isNull(), "unfilled")
        .when(F.size(reasons) > 0, "rejected")
        .when(F.col("filled_quantity") < F.col("quantity"), "partially_filled")
        .otherwise("filled")
    )
    final = F.when(F.col("executed_at").isNull(), F.array(F.lit("no_next_bar"))).otherwise(reasons)
    return orders.withColumns({"status": status, "reasons": final})
