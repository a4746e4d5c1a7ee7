"""Join, signal, pricing and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.cells import failed
from tapeworks.functions.series import DAILY, Grid
from tapeworks.operators import pricing, risk, rules, sessions, signals
from tapeworks.plans import fixtures as fx
from tapeworks.plans.registry import query, rounded, sql_stamp, stamp
from tapeworks.plans.views import view
from tapeworks.sources.bars import test_window

BAR = 3600
GRID = Grid(bar_seconds=86400)

# --- joins -------------------------------------------------------------------------------

view(
    "session_flags",
    f"""
SELECT b.*, coalesce(b.ts BETWEEN opens_at AND closes_at, false) AS in_session,
  coalesce(b.ts - INTERVAL {BAR} SECOND >= opens_at AND b.ts <= closes_at, false) AS executable
FROM session_bars b LEFT JOIN sessions s ON s.session_date = CAST(b.ts + INTERVAL 330 MINUTE AS DATE)""",
)


@query(
    "session_join",
    f"SELECT instrument_id, {sql_stamp()} AS ts, in_session, executable FROM session_flags",
)
def session_join(spark, sf):
    rows = sessions.session_join(fx.session_bars(spark, sf), fx.sessions(spark, sf), BAR)
    return rows.select("instrument_id", stamp().alias("ts"), "in_session", "executable")


@query(
    "holiday_anti",
    f"""SELECT instrument_id, {sql_stamp()} AS ts FROM session_bars
    WHERE CAST(ts + INTERVAL 330 MINUTE AS DATE) NOT IN (SELECT holiday FROM holidays)""",
)
def holiday_anti(spark, sf):
    rows = sessions.not_on_holiday(fx.session_bars(spark, sf), fx.holidays(spark, sf))
    return rows.select("instrument_id", stamp().alias("ts"))


@query(
    "contract_join",
    """SELECT b.symbol, b.bar_time, c.contract_id, c.lot_size FROM typed_bars b
    LEFT JOIN contracts c ON c.symbol = b.symbol""",
)
def contract_join(spark, sf):
    bars = fx.raw_bars(spark, sf).select("symbol", F.col("ts").alias("bar_time"))
    joined = sessions.contract_join(bars, fx.contracts(spark, sf))
    return joined.select("symbol", "bar_time", "contract.contract_id", "contract.lot_size")


def _signals_at_noon(spark, sf):
    """Orders half a day after every bar, so the next bar is found by time."""
    bars = fx.bars_daily(spark, sf)
    return bars.select(
        "instrument_id", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("ts"), "volume"
    )


_NOON = "(SELECT instrument_id, ts + INTERVAL 12 HOUR AS ts, volume FROM bars_daily)"


@query(
    "next_open_fill",
    f"""SELECT o.instrument_id, {sql_stamp("o.ts")} AS ts, {sql_stamp("b.ts")} AS next_ts,
    b.open AS next_open, CASE WHEN b.ts IS NULL THEN 'no_next_bar' END AS unfilled_reason
    FROM {_NOON} o ASOF LEFT JOIN bars_daily b ON o.instrument_id = b.instrument_id AND o.ts < b.ts""",
)
def next_open_fill(spark, sf):
    priced = pricing.next_open(
        _signals_at_noon(spark, sf), fx.bars_daily(spark, sf).drop("volume"), GRID
    )
    return priced.select(
        "instrument_id", stamp().alias("ts"), stamp("next_ts").alias("next_ts"), "next_open",
        "unfilled_reason",
    )


@query(
    "quote_asof",
    f"""SELECT o.instrument_id, {sql_stamp("o.ts")} AS ts, {sql_stamp("b.ts")} AS last_ts, b.close AS last_close
    FROM {_NOON} o ASOF LEFT JOIN bars_daily b ON o.instrument_id = b.instrument_id AND o.ts >= b.ts""",
)
def quote_asof(spark, sf):
    found = sessions.latest_before(
        _signals_at_noon(spark, sf), fx.bars_daily(spark, sf), ["instrument_id"], ["close"], GRID
    )
    return found.select(
        "instrument_id", stamp().alias("ts"), stamp("last_ts").alias("last_ts"), "last_close"
    )


# --- signals -----------------------------------------------------------------------------

view(
    "cross_values",
    """
SELECT *, CASE WHEN idx < 20 THEN 'hold' WHEN fp * 20 <= sp * 5 AND f * 20 > s * 5 THEN 'buy'
  WHEN fp * 20 >= sp * 5 AND f * 20 < s * 5 THEN 'sell' ELSE 'hold' END AS side
FROM (SELECT instrument_id, ts, close, row_number() OVER w - 1 AS idx,
  sum(close) OVER (w ROWS 4 PRECEDING) AS f, sum(close) OVER (w ROWS 19 PRECEDING) AS s,
  sum(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS fp,
  sum(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sp
  FROM bars_daily WINDOW w AS (PARTITION BY instrument_id ORDER BY ts))""",
)


@query("sig_crossover", f"SELECT instrument_id, {sql_stamp()} AS ts, side FROM cross_values")
def sig_crossover(spark, sf):
    rows = signals.crossover(fx.bars_daily(spark, sf), DAILY)
    return rows.select("instrument_id", stamp().alias("ts"), "side")


@query(
    "sig_explain",
    f"""SELECT instrument_id, {sql_stamp()} AS ts,
    CASE WHEN idx < 20 THEN 'fewer than 21 closes so far' ELSE side || ': mean of 5 closes against mean of 20' END
    || '; research by feed, account worth ' || CAST(close AS VARCHAR) AS explanation FROM cross_values""",
)
def sig_explain(spark, sf):
    rows = signals.crossover(fx.bars_daily(spark, sf), DAILY)
    told = signals.explain(rows, "feed", "close")
    return told.select("instrument_id", stamp().alias("ts"), "explanation")


@query(
    "sig_orders",
    f"""SELECT 'research-' || substr(sha256(instrument_id), 1, 16) || '-' || CAST(epoch(ts) AS BIGINT) AS client_order_id,
    instrument_id AS symbol, instrument_id, {sql_stamp()} AS ts, side, 7::BIGINT AS quantity, 'equity_delivery' AS product,
    CAST(close * CASE side WHEN 'buy' THEN 0.95 ELSE 1.05 END AS DECIMAL(18,4)) AS stop_loss
    FROM cross_values WHERE side <> 'hold'""",
)
def sig_orders(spark, sf):
    bars = fx.bars_daily(spark, sf).withColumns({"asset_class": F.lit("equity"), "symbol": F.col("instrument_id")})
    orders = signals.orders_from(signals.crossover(bars, DAILY), 7)
    return orders.select(
        "client_order_id", "symbol", "instrument_id", stamp().alias("ts"), "side", "quantity", "product", "stop_loss"
    )


@query(
    "sig_gate",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, '' AS reasons FROM session_flags
    WHERE executable AND ts >= TIMESTAMP '1997-01-01'
    UNION ALL SELECT DISTINCT 'calendar', {sql_stamp()}, 'calendar_closed' FROM session_flags
    WHERE NOT executable AND ts >= TIMESTAMP '1997-01-01'""",
)
def sig_gate(spark, sf):
    bars = test_window(fx.session_bars(spark, sf), "1997-01-01", None)
    kept, audit = signals.signal_gate(bars, fx.sessions(spark, sf), BAR)
    return kept.select("instrument_id", stamp().alias("ts"), F.lit("").alias("reasons")).unionByName(
        audit.select(
            F.col("client_order_id").alias("instrument_id"),
            stamp().alias("ts"),
            F.array_join("reasons", ",").alias("reasons"),
        )
    )


@query(
    "sig_probability",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, CASE WHEN desired THEN 'buy' ELSE 'sell' END AS side
    FROM (SELECT *, lag(desired, 1, false) OVER (PARTITION BY instrument_id ORDER BY ts) AS was FROM (
      SELECT g.instrument_id, g.ts, g.volume / (g.volume + 40.0::DOUBLE) >= 0.5 AS desired
      FROM session_flags g JOIN (SELECT instrument_id, ts, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS n
        FROM session_bars) h USING (instrument_id, ts) WHERE executable AND n >= 26))
    WHERE desired <> was""",
)
def sig_probability(spark, sf):
    bars = signals.with_history(fx.session_bars(spark, sf), DAILY)
    kept, _ = signals.signal_gate(bars, fx.sessions(spark, sf), BAR)
    scored = kept.withColumn("p", F.col("volume") / (F.col("volume") + F.lit(40.0)))
    rows = signals.probability_signals(scored, DAILY)
    return rows.select("instrument_id", stamp().alias("ts"), "side")


# --- costs and prices --------------------------------------------------------------------

# Rates made up for these tables: buy rate, sell rate, cap.
_SCHEDULE = {
    "equity_delivery": dict(
        brokerage=("0.0004", "0.0003", "11"), stt=("0", "0.0007", None),
        exchange=("0.00005", "0.00005", None), sebi=("0.000003", "0.000003", None),
        stamp=("0.00004", "0", None), gst_rate="0.07",
    ),
    "equity_intraday": dict(
        brokerage=("0.0005", "0.0006", "13"), stt=("0", "0.0002", None),
        exchange=("0.00003", "0.00004", None), stamp=("0.00006", "0", None), gst_rate="0.07",
        gst=("brokerage", "brokerage", "exchange"),
    ),
    "future": dict(brokerage=("0.0007", "0.0008", "17"), sebi=("0.000004", "0.000005", None)),
    "option": dict(),
}


def _fee_sql(fee: str) -> str:
    """The schedule's twin: one CASE over products."""
    cases = []
    for product, fees in _SCHEDULE.items():
        if fee in fees:
            buy, sell, cap = fees[fee]
            paid = f"turnover * CASE side WHEN 'buy' THEN {buy}::DECIMAL(8,6) ELSE {sell}::DECIMAL(8,6) END"
            cases.append(f"WHEN '{product}' THEN " + (f"least({paid}, {cap})" if cap else paid))
    return f"CASE product {' '.join(cases)} ELSE 0 END AS {fee}"


def _schedules(spark):
    return pricing.cost_schedules(
        spark, [pricing.schedule_row(product, **fees) for product, fees in _SCHEDULE.items()]
    )


def _priced_fills(spark, sf):
    kind = (F.col("price") * 100).cast("bigint") % 5
    product = (
        F.when(kind == 0, "equity_delivery").when(kind == 1, "equity_intraday")
        .when(kind == 2, "future").when(kind == 3, "option").otherwise("unknown")
    )
    return fx.fills(spark, sf).withColumn("product", product)


view(
    "priced_fills",
    """
SELECT *, price * quantity AS turnover, CASE CAST(price * 100 AS BIGINT) % 5 WHEN 0 THEN 'equity_delivery'
  WHEN 1 THEN 'equity_intraday' WHEN 2 THEN 'future' WHEN 3 THEN 'option' ELSE 'unknown' END AS product FROM fills""",
)
view(
    "fee_rows",
    f"""
SELECT *, CASE product WHEN 'equity_delivery' THEN (brokerage + exchange + sebi)::DOUBLE * 0.07::DOUBLE
    WHEN 'equity_intraday' THEN (brokerage + exchange)::DOUBLE * 0.07::DOUBLE ELSE 0 END AS gst_fee
FROM (SELECT client_order_id, account, symbol, product, side, ts,
  {", ".join(map(_fee_sql, ("brokerage", "stt", "exchange", "sebi", "stamp")))} FROM priced_fills)""",
)


@query(
    "costs",
    """SELECT client_order_id, account, symbol, product, round(brokerage::DOUBLE, 10) AS brokerage,
    round(stt::DOUBLE, 10) AS stt, round(exchange::DOUBLE, 10) AS exchange, round(sebi::DOUBLE, 10) AS sebi,
    round(stamp::DOUBLE, 10) AS stamp, round(gst_fee::DOUBLE, 10) AS gst_fee FROM fee_rows""",
)
def costs(spark, sf):
    rows = pricing.with_costs(_priced_fills(spark, sf), _schedules(spark))
    return rows.select(
        "client_order_id", "account", "symbol", "product", *rounded([*pricing.FEES, "gst_fee"], 10)
    )


@query(
    "cost_join",
    """SELECT product, side, CASE WHEN product = 'unknown' THEN 'missing_cost_schedule' END AS cost_reason,
    count(*) AS n, round(sum((brokerage + stt + exchange + sebi + stamp)::DOUBLE + gst_fee), 4) AS total_cost
    FROM fee_rows GROUP BY ALL""",
)
def cost_join(spark, sf):
    rows = pricing.with_costs(_priced_fills(spark, sf), _schedules(spark))
    totals = rows.groupBy("product", "side", "cost_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cost").alias("total_cost")
    )
    return totals.select("product", "side", "cost_reason", "n", *rounded(["total_cost"], 4))


view(
    "prior_values",
    """
SELECT *, coalesce(lag(volume) OVER w, 0) AS prior_volume,
  coalesce(abs(lag(close) OVER w / lag(close, 2) OVER w - 1), 0) AS volatility
FROM bars_daily WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)""",
)
view(
    "slip_values",
    """
SELECT *, CASE WHEN side = 'buy' THEN ceil(round(raw / 0.05::DOUBLE, 6)) ELSE floor(round(raw / 0.05::DOUBLE, 6)) END
  AS steps FROM (SELECT *, open::DOUBLE * CASE WHEN side = 'buy' THEN 1 + f ELSE 1 - f END AS raw FROM (
    SELECT *, 0.0007::DOUBLE + 0.1::DOUBLE * volatility AS f, volume % 10 + 1 AS quantity,
      CASE WHEN volume % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM prior_values))""",
)
view(
    "slip_fills",
    """
SELECT *, CASE WHEN raw <= 0 OR steps <= 0 THEN open ELSE CAST(CAST(steps AS BIGINT) * 0.05 AS DECIMAL(18,4)) END AS fill_price,
  CASE WHEN raw <= 0 OR steps <= 0 THEN 'invalid_slippage_price' END AS slippage_reason FROM slip_values""",
)

SLIP = pricing.Slippage(bps="5", percentage="0.0002", volatility_multiplier="0.1")


def _tick():
    return F.lit("0.05").cast("decimal(10,4)")


def _slipped(spark, sf):
    bars = pricing.prior_bars(fx.bars_daily(spark, sf), DAILY)
    orders = bars.withColumns(
        {
            "side": F.when(F.col("volume") % 2 == 0, "buy").otherwise("sell"),
            "quantity": F.col("volume") % 10 + 1,
        }
    )
    return pricing.slipped_fill(orders, SLIP, _tick())


@query(
    "slippage",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, side, CAST(fill_price AS DOUBLE) AS fill_price,
    round(abs(fill_price - open)::DOUBLE * quantity, 4) AS slippage_cost, slippage_reason FROM slip_fills""",
)
def slippage(spark, sf):
    return _slipped(spark, sf).select(
        "instrument_id", stamp().alias("ts"), "side", F.col("fill_price").cast("double").alias("fill_price"),
        *rounded(["slippage_cost"], 4), "slippage_reason",
    )


@query(
    "tick_round",
    f"""SELECT instrument_id, {sql_stamp()} AS ts,
    CASE WHEN volume % 7 > 0 THEN CAST((CAST(close * 100 AS BIGINT) + 24) // 25 * 25 / 100 AS DOUBLE) END AS buy_price,
    CASE WHEN volume % 7 > 0 THEN CAST(CAST(close * 100 AS BIGINT) // 25 * 25 / 100 AS DOUBLE) END AS sell_price
    FROM bars_daily""",
)
def tick_round(spark, sf):
    """Ticks of a quarter; every seventh volume stands for an instrument whose tick is zero."""
    tick = F.when(F.col("volume") % 7 > 0, F.lit("0.25")).otherwise("0").cast("decimal(10,4)")
    price = F.col("close").cast("decimal(38,20)")
    return fx.bars_daily(spark, sf).select(
        "instrument_id",
        stamp().alias("ts"),
        pricing.to_tick(price, tick, F.lit("buy")).cast("double").alias("buy_price"),
        pricing.to_tick(price, tick, F.lit("sell")).cast("double").alias("sell_price"),
    )


@query(
    "limit_check",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, array_to_string(list_filter([
      CASE WHEN CAST(close * 100 AS BIGINT) % 5 <> 0 THEN 'invalid_limit_tick' END,
      CASE WHEN side = 'buy' AND fill_price > close OR side = 'sell' AND fill_price < close
           THEN 'limit_not_marketable_at_open' END], lambda x: x IS NOT NULL), ',') AS reasons FROM slip_fills""",
)
def limit_check(spark, sf):
    rows = _slipped(spark, sf).withColumn("limit_price", F.col("close").cast("decimal(18,4)"))
    found = pricing.limit_reasons(_tick())
    return rows.select(
        "instrument_id", stamp().alias("ts"), F.array_join(found, ",").alias("reasons")
    )


@query(
    "eligibility",
    """SELECT b.symbol, b.bar_time, array_to_string(list_filter([
      CASE WHEN asset_class <> 'equity' AND contract_id IS NULL THEN 'missing_contract' END,
      CASE WHEN asset_class <> 'equity' AND contract_id IS NOT NULL AND (
        CASE WHEN c.instrument_type LIKE 'OPT%' THEN 'option' ELSE 'future' END
          <> CASE WHEN asset_class = 'future' THEN 'future' ELSE 'option' END
        OR c.expiry IS DISTINCT FROM b.expiry OR c.underlying IS DISTINCT FROM b.underlying
        OR c.strike IS DISTINCT FROM b.strike OR c.option_type IS DISTINCT FROM b.option_type)
        THEN 'contract_mismatch' END,
      CASE WHEN CASE WHEN asset_class = 'equity' THEN false ELSE asset_class <> 'future' END
        THEN 'cost_product_mismatch' END,
      CASE WHEN contract_id IS NOT NULL AND (lot_size = 0 OR 10 % lot_size <> 0) THEN 'invalid_lot_quantity' END],
      lambda x: x IS NOT NULL), ',') AS reasons
    FROM typed_bars b LEFT JOIN contracts c ON c.symbol = b.symbol""",
)
def eligibility(spark, sf):
    """Ten of everything, futures traded as futures and options wrongly as futures."""
    bars = rules.parse_bars(fx.raw_bars(spark, sf).withColumn("bar_time", F.col("ts")))
    contracts = fx.contracts(spark, sf)
    orders = sessions.contract_join(bars, contracts).withColumns(
        {
            "instrument_type": F.col("asset_class"),
            "quantity": F.lit(10).cast("bigint"),
            "product": F.when(F.col("asset_class") == "equity", "equity_delivery").otherwise("future"),
        }
    )
    found = pricing.eligibility_reasons()
    return orders.select("symbol", "bar_time", F.array_join(found, ",").alias("reasons"))


# --- liquidity ---------------------------------------------------------------------------

view(
    "open_orders",
    """
SELECT instrument_id, executed_at, arrival, max(quantity) AS quantity, max(lot) AS lot_size,
  max(prior_volume) AS capacity, bool_and(eligible) AS eligible
FROM (SELECT p_brand AS instrument_id, date_trunc('month', l_shipdate) AS executed_at,
    l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS arrival,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(substr(p_brand, 7) AS INTEGER) % 3 + 1 AS lot, l_returnflag <> 'R' AS eligible,
    100 + p_partkey * 0 + month(l_shipdate) * 10 AS prior_volume
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY instrument_id, executed_at, arrival""",
)


def _open_orders(spark, sf):
    """Every line item as an order at its month's open; room depends on the month."""
    part = fx.table(spark, sf, "part").select("p_partkey", "p_brand")
    lines = fx.table(spark, sf, "lineitem")
    c = F.col
    rows = lines.join(part, c("l_partkey") == c("p_partkey")).select(
        c("p_brand").alias("instrument_id"),
        F.date_trunc("month", c("l_shipdate").cast("timestamp")).alias("executed_at"),
        (c("l_orderkey") * 1000000000 + c("l_linenumber") * 100000000 + c("l_partkey") * 1000
         + c("l_suppkey") % 1000).alias("arrival"),
        c("l_quantity").cast("bigint").alias("quantity"),
        # A lot belongs to the instrument.
        (F.substring("p_brand", 7, 9).cast("int") % 3 + 1).alias("lot"),
        (F.lit(100) + F.month("l_shipdate") * 10).cast("bigint").alias("room"),
        (c("l_returnflag") != "R").alias("eligible"),
    )
    return rows.groupBy("instrument_id", "executed_at", "arrival").agg(
        F.max("quantity").alias("quantity"),
        F.max("lot").alias("lot_size"),
        F.max("room").alias("capacity"),
        F.bool_and("eligible").alias("eligible"),
    )


_STEPS = """WITH seq AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, executed_at ORDER BY arrival) AS n
    FROM open_orders),
  steps AS (SELECT instrument_id, executed_at, arrival, n, {first} FROM (SELECT *, capacity AS rest FROM seq WHERE n = 1) r
    UNION ALL SELECT q.instrument_id, q.executed_at, q.arrival, q.n, {next}
    FROM steps r JOIN seq q ON q.instrument_id = r.instrument_id AND q.executed_at = r.executed_at AND q.n = r.n + 1)"""


def _take(q: str) -> str:
    ok = f"({q}.eligible AND {q}.quantity <= r.rest)"
    return f"CASE WHEN {ok} THEN r.rest - {q}.quantity ELSE r.rest END AS rest, {ok} AS accepted, {q}.eligible AS eligible"


@query(
    "liquidity_fold",
    _STEPS.format(first=_take("r"), next=_take("q"))
    + f""" SELECT instrument_id, {sql_stamp("executed_at")} AS executed_at, arrival, accepted,
    CASE WHEN eligible AND NOT accepted THEN 'partial_fill_unsupported' END AS liquidity_reason FROM steps""",
)
def liquidity_fold(spark, sf):
    rows = pricing.full_fills(_open_orders(spark, sf), DAILY)
    return rows.select(
        "instrument_id", stamp("executed_at").alias("executed_at"), "arrival", "accepted",
        "liquidity_reason",
    )


@query(
    "liquidity_reject",
    f"""SELECT instrument_id, {sql_stamp("executed_at")} AS executed_at, arrival, false AS accepted,
    CASE WHEN eligible THEN 'fill_model_reject' END AS liquidity_reason FROM open_orders""",
)
def liquidity_reject(spark, sf):
    rows = pricing.rejected_fills(_open_orders(spark, sf))
    return rows.select(
        "instrument_id", stamp("executed_at").alias("executed_at"), "arrival", "accepted", "liquidity_reason"
    )


def _part_take(q: str) -> str:
    want = f"least(CAST(floor({q}.quantity * 0.29) AS BIGINT), r.rest) // {q}.lot_size * {q}.lot_size"
    got = f"CASE WHEN {q}.eligible THEN {want} ELSE 0 END"
    return f"r.rest - {got} AS rest, {got} AS filled_quantity, {q}.eligible AS eligible"


@query(
    "liquidity_partial",
    _STEPS.format(first=_part_take("r"), next=_part_take("q"))
    + f""" SELECT instrument_id, {sql_stamp("executed_at")} AS executed_at, arrival, filled_quantity,
    CASE WHEN eligible AND filled_quantity <= 0 THEN 'no_fill_quantity' END AS liquidity_reason FROM steps""",
)
def liquidity_partial(spark, sf):
    rows = pricing.partial_fills(_open_orders(spark, sf), DAILY, "0.29")
    return rows.select(
        "instrument_id", stamp("executed_at").alias("executed_at"), "arrival", "filled_quantity",
        "liquidity_reason",
    )


@query(
    "fill_status",
    _STEPS.format(first=_part_take("r"), next=_part_take("q"))
    + """ SELECT status, reasons, count(*) AS n FROM (
      SELECT CASE WHEN NOT eligible OR filled_quantity <= 0 THEN 'rejected'
        WHEN filled_quantity < quantity THEN 'partially_filled' ELSE 'filled' END AS status,
        CASE WHEN NOT eligible THEN 'instrument_mismatch' WHEN filled_quantity <= 0 THEN 'no_fill_quantity' ELSE '' END AS reasons
      FROM steps JOIN (SELECT instrument_id, executed_at, arrival, quantity FROM open_orders) USING (instrument_id, executed_at, arrival))
    GROUP BY ALL""",
)
def fill_status(spark, sf):
    rows = pricing.partial_fills(_open_orders(spark, sf), DAILY, "0.29")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("eligible"), "instrument_mismatch"),
            F.when(~F.col("eligible"), "instrument_mismatch"),
            F.col("liquidity_reason"),
        )
    )
    done = pricing.fill_status(rows.withColumn("reasons", reasons))
    return done.groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- risk --------------------------------------------------------------------------------

POLICY = risk.Policy(
    allowed_symbols=frozenset(f"BRAND-{n}" for n in range(1, 23)),
    holidays=frozenset({"1996-03-05", "1997-07-01"}),
)
_SYMBOLS = ", ".join(f"'{s}'" for s in sorted(POLICY.allowed_symbols))


def _limits_sql(price: str) -> list[tuple[str, str]]:
    amount = f"({price} * quantity)"
    return [
        ("capital_per_trade", f"{amount} > 10000"),
        ("daily_loss", "equity - day_start_equity <= -5000"),
        ("insufficient_cash", f"side = 'buy' AND {amount} > cash"),
        ("portfolio_exposure", f"side = 'buy' AND exposure + {amount} > 50000"),
        ("open_positions", "side = 'buy' AND held IS NULL AND open_positions >= 5"),
        ("insufficient_position", "side = 'sell' AND (held IS NULL OR quantity > held)"),
        (
            "invalid_stop_loss",
            f"stop_loss IS NULL OR NOT CASE WHEN side = 'buy' THEN stop_loss > 0 AND stop_loss < {price} "
            f"ELSE stop_loss > {price} END",
        ),
    ]


_HOURS_SQL = (
    "isodow(local_now) >= 6 OR strftime(local_now, '%Y-%m-%d') IN ('1996-03-05', '1997-07-01') "
    "OR hour(local_now) * 60 + minute(local_now) < 555 OR hour(local_now) * 60 + minute(local_now) >= 930"
)
_QUOTE_SQL = [
    ("quote_mismatch", "quote_symbol <> symbol OR quote_type <> instrument_type"),
    ("future_quote", "age < 0"),
    ("stale_quote", "age > 30"),
]


def _screen_sql(price: str = "quote_price") -> list[tuple[str, str]]:
    return [
        ("market_closed", _HOURS_SQL),
        ("duplicate_order", "repeated"),
        ("symbol_not_allowed", f"symbol NOT IN ({_SYMBOLS})"),
        ("instrument_type_not_allowed", "instrument_type <> 'equity'"),
        *_QUOTE_SQL,
        *_limits_sql(price),
    ]


def _reasons_sql(checks: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in checks)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _rows(spark, sf):
    orders = risk.mark_repeats(fx.risk_orders(spark, sf), ["arrival"])
    return risk.with_positions(
        orders, fx.account_states(spark, sf), fx.held_positions(spark, sf)
    )


@query(
    "risk_screen",
    f"""SELECT arrival, len(r) = 0 AS approved, array_to_string(r, ',') AS reasons
    FROM (SELECT arrival, {_reasons_sql(_screen_sql())} AS r FROM screen_rows)""",
)
def risk_screen(spark, sf):
    rows = risk.risk_screen(_rows(spark, sf), POLICY)
    return rows.select("arrival", "approved", F.array_join("reasons", ",").alias("reasons"))


def _risk_part(name: str, checks_sql: list[tuple[str, str]], checks) -> None:
    @query(
        name,
        f"SELECT arrival, array_to_string({_reasons_sql(checks_sql)}, ',') AS reasons FROM screen_rows",
    )
    def run(spark, sf):
        found = failed(checks())
        return _rows(spark, sf).select("arrival", F.array_join(found, ",").alias("reasons"))


_risk_part(
    "risk_market_hours",
    [("market_closed", _HOURS_SQL)],
    lambda: {"market_closed": risk.market_closed(POLICY, F.col("now"))},
)
_risk_part("risk_quote", _QUOTE_SQL, lambda: risk.quote_checks(POLICY))
_risk_part(
    "risk_limits",
    _limits_sql("quote_price"),
    lambda: risk.limit_checks(POLICY, F.col("quote_price"), F.col("quantity")),
)
_risk_part(
    "allowlist_anti",
    [
        ("symbol_not_allowed", f"symbol NOT IN ({_SYMBOLS})"),
        ("instrument_type_not_allowed", "instrument_type <> 'equity'"),
    ],
    lambda: risk.allowlist(POLICY),
)


@query(
    "dup_orders",
    """SELECT arrival, CAST(order_no AS VARCHAR) AS client_order_id FROM screen_rows
    WHERE repeated OR order_no % 1000 = 500""",
)
def dup_orders(spark, sf):
    """Repeats inside the batch, and ids already used in the stored history."""
    orders = fx.risk_orders(spark, sf)
    history = orders.filter(F.col("client_order_id").cast("bigint") % 1000 == 500)
    marked = risk.mark_repeats(orders, ["arrival"], history.select("client_order_id"))
    return marked.filter("repeated").select("arrival", "client_order_id")


@query(
    "risk_two_price",
    f"""SELECT arrival, array_to_string(list_sort(list_distinct(list_concat({_reasons_sql(_screen_sql())},
      {_reasons_sql(_screen_sql("(quote_price + 3.50)"))}))), ',') AS reasons FROM screen_rows""",
)
def risk_two_price(spark, sf):
    rows = _rows(spark, sf).withColumn(
        "fill_price", (F.col("quote_price") + F.lit("3.50").cast("decimal(4,2)")).cast("decimal(18,4)")
    )
    both = risk.two_price_screen(rows, POLICY)
    return both.select("arrival", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query(
    "cash_after_costs",
    """SELECT arrival, CASE WHEN side = 'buy' THEN amount + 2.36 ELSE 2.36 - amount END > cash AS short_of_cash
    FROM screen_rows""",
)
def cash_after_costs(spark, sf):
    need = risk.cash_after_costs(
        F.col("quote_price"), F.col("quantity"), F.lit("2.36").cast("decimal(6,2)")
    )
    return _rows(spark, sf).select("arrival", (need > F.col("cash")).alias("short_of_cash"))


@query(
    "risk_status",
    """SELECT account, 'paper' AS execution_mode, equity - day_start_equity AS daily_pnl,
    equity - day_start_equity <= -5000 AS daily_loss_blocked FROM account_states""",
)
def risk_status(spark, sf):
    rows = risk.risk_status(fx.account_states(spark, sf), POLICY)
    return rows.select(
        "account", "execution_mode", F.col("daily_pnl").cast("decimal(19,2)").alias("daily_pnl"),
        "daily_loss_blocked",
    )


@query(
    "v_held_quotes",
    """SELECT h.account, h.symbol, coalesce(q.age BETWEEN 0 AND 30 AND q.symbol NOT LIKE '%7', false) AS quote_ok
    FROM held_positions h LEFT JOIN (SELECT symbol, (CAST(substr(symbol, 7) AS BIGINT) * 3 - 6) AS age
      FROM (SELECT DISTINCT symbol FROM risk_orders)) q ON q.symbol = h.symbol""",
)
def v_held_quotes(spark, sf):
    now = F.lit("1998-01-05 05:00:00").cast("timestamp")
    age = F.substring("symbol", 7, 9).cast("bigint") * 3 - 6
    quotes = fx.risk_orders(spark, sf).select("symbol").distinct()
    quotes = quotes.select(
        "symbol",
        F.timestamp_micros(F.unix_micros(now) - age * 1_000_000).alias("quote_ts"),
        F.when(F.col("symbol").endswith("7"), "etf").otherwise("equity").alias("quote_type"),
    )
    held = fx.held_positions(spark, sf).withColumn("now", now)
    return rules.held_quotes_ok(held, quotes, 30).select("account", "symbol", "quote_ok")


@query(
    "v_orders",
    """SELECT arrival FROM risk_orders WHERE arrival % 29 = 0 OR quantity = 4 OR arrival % 23 = 0
    OR (arrival % 2 = 0) <> (arrival % 3 = 0)""",
)
def v_orders(spark, sf):
    k = F.col("arrival")
    money = "decimal(18,2)"
    orders = fx.risk_orders(spark, sf).withColumns(
        {
            "client_order_id": F.when(k % 29 == 0, "bad id!").otherwise(F.col("client_order_id")),
            "quantity": F.when(F.col("quantity") == 4, F.lit(1.5)).otherwise(
                F.col("quantity").cast("double")
            ),
            "side": F.when(k % 23 == 0, "short").otherwise(F.col("side")),
            "order_type": F.when(k % 2 == 0, "limit").otherwise("market"),
            "limit_price": F.when(k % 3 == 0, F.lit(10).cast(money)),
            "product": F.lit("equity_delivery"),
        }
    )
    return rules.split(rules.flag(orders, rules.order_rules()))[1].select("arrival")
