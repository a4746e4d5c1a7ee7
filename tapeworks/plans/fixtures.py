"""Market tables derived from the given star-schema tables (see FIXTURES.md part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str):
    return F.col(column).cast("decimal(18,2)")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        _money("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )
    return (
        lines.join(part, "p_partkey")
        .groupBy(F.col("p_brand").alias("instrument_id"), "ts")
        .agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
            F.sum("quantity").alias("volume"),
        )
    )


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument_id"),
        (F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 HOUR")).alias(
            "closed"
        ),
        _money("value").alias("price"),
        F.struct("ts", "event_id").alias("at"),
    )
    return events.groupBy("instrument_id", F.col("closed").alias("ts")).agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def research_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as doubles, with derivative columns made up arithmetically and some left null."""
    bars = bars_daily(spark, sf_dir)
    volume = F.col("volume")

    def unless(n: int, value):
        return F.when(volume % n != 0, value)

    return bars.select(
        "instrument_id",
        "ts",
        *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low", "volume")],
        unless(7, (volume * 10).cast("double")).alias("open_interest"),
        unless(11, F.col("open").cast("double")).alias("underlying_price"),
        unless(13, F.col("low").cast("double")).alias("strike"),
        unless(5, F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expiry"),
        F.lit("fixture").alias("provenance"),
        F.lit("v1").alias("dataset_version"),
        F.lit(True).alias("synthetic"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        "lang",
        F.col("quality").cast("bigint").alias("y"),
        (n / (n + F.lit(1000.0))).alias("p"),
        ((F.col("n_chars") % 41) - 20).cast("double").alias("move"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; about a third are sells, many of more than is held."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("symbol"))
    sell = F.col("l_returnflag") == "R"
    # Ids are told apart as numbers, before they are made. A missing one leaves no gap in the id.
    first = F.coalesce("l_orderkey", "l_linenumber")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(
            first.alias("first"),
            F.when(F.col("l_orderkey").isNotNull(), F.col("l_linenumber")).alias("second"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            F.coalesce(sell, F.lit(False)).alias("sells"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            _money("l_extendedprice").alias("price"),
            F.round(F.col("l_tax") * 100, 0).cast("decimal(18,2)").alias("cost"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
        )
        .groupBy("first", "second", "part", "supplier", "ts")
        .agg(
            # A largest text would have to be sorted for.
            F.max("sells").alias("sells"),
            F.max("quantity").alias("quantity"),
            F.max("price").alias("price"),
            F.max("cost").alias("cost"),
        )
    )
    return lines.join(part.distinct(), "part").select(
        F.concat(F.lit("A"), (F.col("supplier") % 10).cast("string")).alias("account"),
        F.concat_ws("-", "first", "second", "part", "supplier").alias("client_order_id"),
        "symbol",
        "ts",
        F.when(F.col("sells"), "sell").otherwise("buy").alias("side"),
        "quantity",
        "price",
        "cost",
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hourly(spark, sf_dir).select(
        F.col("instrument_id").alias("run_id"),
        "ts",
        (F.col("close") + F.lit(10000).cast("decimal(10,0)"))
        .cast("decimal(18,2)")
        .alias("equity"),
        (F.col("volume") * F.col("close")).cast("decimal(18,2)").alias("exposure"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells as a feed would deliver them, with faults sown at regular distances."""
    num = F.regexp_replace("instrument_id", "Brand#", "").cast("bigint")
    bars = bars_daily(spark, sf_dir).withColumn("num", num).withColumn("cls", F.col("num") % 5)
    bars = bars.withColumn(
        "k",
        F.datediff(F.to_date("ts"), F.lit("1995-01-01").cast("date")) * F.lit(31)
        + F.col("num") * 7,
    )
    cls, num = F.col("cls"), F.col("num").cast("string")

    def every(n: int):
        return F.col("k") % n == 0

    def text(name: str):
        return F.col(name).cast("string")

    local = F.date_format(F.col("ts") + F.expr("INTERVAL 570 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss")
    oi = F.when(every(283), "2.5").otherwise((F.col("volume") * 10).cast("string"))
    return bars.select(
        "instrument_id",
        F.when(every(211), "bond").when(cls < 3, "equity").when(cls == 3, "future")
        .otherwise("option").alias("asset_class"),
        F.when(every(223), " BAD").otherwise(F.concat(F.lit("BRAND-"), num)).alias("symbol"),
        F.lit("NSE").alias("exchange"),
        F.concat(local, F.when(every(227), "").otherwise("+05:30")).alias("ts"),
        F.when(every(239), "0.00").otherwise(text("open")).alias("open"),
        F.when(every(229), "NaN").when(every(233), text("low")).otherwise(text("high"))
        .alias("high"),
        F.when(every(233), text("high")).otherwise(text("low")).alias("low"),
        F.when(every(293), "").otherwise(text("close")).alias("close"),
        F.when(every(241), "1.5").when(every(251), "-1").otherwise(text("volume")).alias("volume"),
        F.when((cls >= 3) & ~every(257), F.concat(F.lit("UL-"), num)).alias("underlying"),
        F.when(cls >= 3, F.when(every(263), "1990-01-01").otherwise("2005-12-31")).alias("expiry"),
        F.when((cls == 4) & ~every(269), "100.00").when((cls == 0) & every(271), "50.00")
        .alias("strike"),
        F.when(cls == 4, F.when(every(277), "XX").otherwise("CE"))
        .when((cls == 3) & every(281), "PE").alias("option_type"),
        F.when(cls >= 3, oi).alias("open_interest"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.regexp_replace("p_brand", "Brand#", "").cast("bigint")
    part = table(spark, sf_dir, "part").groupBy(num.alias("num")).agg(
        F.max("p_size").cast("bigint").alias("lot")
    )
    n, text = F.col("num"), F.col("num").cast("string")
    money = "decimal(18,4)"
    return part.filter(n % 5 >= 3).select(
        F.concat(F.lit("C-"), text).alias("contract_id"),
        F.when(n % 5 == 3, "FUTSTK").otherwise("OPTSTK").alias("instrument_type"),
        F.concat(F.lit("BRAND-"), text).alias("symbol"),
        F.lit("NSE").alias("exchange"),
        F.when(n % 7 == 1, "OTHER").otherwise(F.concat(F.lit("UL-"), text)).alias("underlying"),
        F.lit("2005-12-31").cast("date").alias("expiry"),
        F.when(n == 8, F.lit(0)).otherwise(F.col("lot")).cast("bigint").alias("lot_size"),
        F.when(n == 18, "0").otherwise("0.05").cast(money).alias("tick_size"),
        F.when((n % 5 == 4) & (n != 9), F.lit("100").cast(money)).alias("strike"),
        F.when((n % 5 == 4) | (n == 13), "CE").alias("option_type"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of the bar dates, 09:15-15:30 in the market zone; firsts of month are off."""
    days = bars_daily(spark, sf_dir).select(F.to_date("ts").alias("session_date")).distinct()
    day = F.col("session_date")
    start = day.cast("timestamp")
    return days.filter((F.weekday(day) <= 4) & (F.dayofmonth(day) != 1)).select(
        day,
        (start + F.expr("INTERVAL 225 MINUTES")).alias("opens_at"),
        (start + F.expr("INTERVAL 600 MINUTES")).alias("closes_at"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_daily(spark, sf_dir).select(F.to_date("ts").alias("holiday")).distinct()
    return days.filter(F.dayofmonth("holiday") == 1)


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars closed at different hours of the market day, some outside the session."""
    minutes = F.lit(225) + (F.col("volume") % 8) * 60
    return bars_daily(spark, sf_dir).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000)
    )


def risk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = (F.floor("o_totalprice").cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    now = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (225 + (k % 9) * 47) * 60_000_000
    )
    sell = F.col("o_orderstatus") == "F"
    symbol = F.concat(F.lit("BRAND-"), (k % 25 + 1).cast("string"))
    five = F.lit(5).cast("decimal(18,2)")
    kind = F.when(k % 47 == 0, "option").otherwise("equity")
    return table(spark, sf_dir, "orders").select(
        k.alias("arrival"),
        F.when(k % 10 == 9, k - 1).otherwise(k).cast("string").alias("client_order_id"),
        F.col("o_custkey").alias("account"),
        symbol.alias("symbol"),
        kind.alias("instrument_type"),
        F.when(sell, "sell").otherwise("buy").alias("side"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("quantity"),
        price.alias("quote_price"),
        F.when(k % 41 == 0, "OTHER").otherwise(symbol).alias("quote_symbol"),
        F.when(k % 43 == 0, "etf").otherwise(kind).alias("quote_type"),
        now.alias("now"),
        F.timestamp_micros(F.unix_micros(now) - (k % 50 - 5) * 1_000_000).alias("quote_ts"),
        F.when(k % 37 == 0, None).when(k % 31 == 0, price).when(sell, price + five)
        .otherwise(price - five).cast("decimal(18,2)").alias("stop_loss"),
    )


def account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    money = "decimal(18,2)"
    cash = (F.col("c_acctbal") * 2).cast(money)
    exposure = (k % 50 * 1000).cast(money)
    return table(spark, sf_dir, "customer").select(
        k.alias("account"),
        cash.alias("cash"),
        exposure.alias("exposure"),
        (cash + exposure).cast(money).alias("equity"),
        (cash + exposure + (k % 60 * 100).cast(money)).cast(money).alias("day_start_equity"),
        (k % 7).alias("open_positions"),
    )


def held_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")

    def symbol(shift: int):
        return F.concat(F.lit("BRAND-"), ((k + shift) % 25 + 1).cast("string")).alias("symbol")

    first = customers.filter(k % 3 != 0).select(
        k.alias("account"), symbol(0), (k % 4 + 1).alias("quantity")
    )
    second = customers.filter(k % 3 == 1).select(
        k.alias("account"), symbol(5), F.lit(3).cast("bigint").alias("quantity")
    )
    return first.unionByName(second)
