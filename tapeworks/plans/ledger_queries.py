"""Ledger, snapshot, performance and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.series import HOURLY, Grid
from tapeworks.operators import ledger as led
from tapeworks.operators import performance as perf
from tapeworks.operators import reconcile as rec
from tapeworks.plans import fixtures as fx
from tapeworks.plans.registry import query, rounded, sql_nudged, sql_rounded, sql_stamp, stamp
from tapeworks.plans.views import view
from tapeworks.session import staged

GRID = Grid(bar_seconds=86400, bucket_rows=64)
CASH = "1000000"

# Sequential twin of the ledger: one step per fill of an (account, symbol).
view(
    "fill_seq",
    """
SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY ts, client_order_id) AS n FROM fills""",
)
view(
    "book_steps",
    """
SELECT account, symbol, n, ts, client_order_id, side, quantity, price, cost, side = 'buy' AS accepted,
  CASE WHEN side = 'buy' THEN quantity ELSE 0 END AS held,
  CASE WHEN side = 'buy' THEN price::DOUBLE ELSE 0 END AS average,
  CASE WHEN side = 'buy' THEN cost::DOUBLE ELSE 0 END AS fees, 0::DOUBLE AS realized
FROM fill_seq WHERE n = 1
UNION ALL
SELECT f.account, f.symbol, f.n, f.ts, f.client_order_id, f.side, f.quantity, f.price, f.cost,
  f.side = 'buy' OR s.held >= f.quantity,
  CASE WHEN f.side = 'buy' THEN s.held + f.quantity WHEN s.held >= f.quantity THEN s.held - f.quantity ELSE s.held END,
  CASE WHEN f.side = 'buy' THEN (s.average * s.held + f.price::DOUBLE * f.quantity) / (s.held + f.quantity)
       WHEN s.held = f.quantity THEN 0 ELSE s.average END,
  CASE WHEN f.side = 'buy' THEN s.fees + f.cost::DOUBLE
       WHEN s.held >= f.quantity THEN s.fees - s.fees * f.quantity / s.held ELSE s.fees END,
  CASE WHEN f.side = 'sell' AND s.held >= f.quantity
       THEN (f.price::DOUBLE - s.average) * f.quantity - s.fees * f.quantity / s.held - f.cost::DOUBLE ELSE 0 END
FROM book_steps s JOIN fill_seq f ON f.account = s.account AND f.symbol = s.symbol AND f.n = s.n + 1""",
)
view("book", "SELECT * FROM book_steps WHERE accepted")


def _book(spark, sf, *without):
    return led.screened_ledger(fx.fills(spark, sf), without=without)


@query(
    "inventory_clamp",
    "SELECT account, symbol, client_order_id, accepted FROM book_steps",
)
def inventory_clamp(spark, sf):
    rows = led.inventory_clamp(fx.fills(spark, sf), GRID)
    return rows.select("account", "symbol", "client_order_id", "accepted")


@query(
    "ledger_fees",
    f"""SELECT account, symbol, client_order_id, held AS quantity_after,
    {sql_nudged("CASE WHEN held > 0 THEN average END", 3)} AS average_price, {sql_nudged("fees", 6)} AS fees_after,
    {sql_nudged("realized", 3)} AS realized_pnl FROM book""",
)
def ledger_fees(spark, sf):
    return _book(spark, sf).select(
        "account", "symbol", "client_order_id", "quantity_after",
        *rounded({"average_price": 3, "fees_after": 6, "realized_pnl": 3}, nudge=True),
    )


@query(
    "ledger",
    """SELECT account, symbol, sum(quantity) FILTER (side = 'buy')::BIGINT AS bought,
    round(sum(CASE WHEN side = 'sell' THEN realized + cost::DOUBLE + fee_share END), 2) AS realized_pnl
    FROM (SELECT *, CASE WHEN side = 'sell' THEN lag(fees) OVER (PARTITION BY account, symbol ORDER BY n) * quantity
            / (held + quantity) END AS fee_share FROM book)
    GROUP BY account, symbol""",
)
def plain_ledger(spark, sf):
    """The ledger without fees, summed per position."""
    free = fx.fills(spark, sf).withColumn("cost", F.lit(0).cast("decimal(18,2)"))
    rows = led.screened_ledger(free, without=led.ORDER).groupBy("account", "symbol").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("quantity"))).alias("bought"),
        F.sum(F.when(F.col("side") == "sell", F.col("realized_pnl"))).alias("realized_pnl"),
    )
    return rows.select("account", "symbol", "bought", *rounded(["realized_pnl"], 2))


view(
    "final_positions",
    """
SELECT account, symbol, arg_max(held, n) AS quantity, arg_max(average, n) AS average_price,
  arg_max(fees, n) AS entry_fees FROM book GROUP BY account, symbol HAVING arg_max(held, n) > 0""",
)
view(
    "last_closes",
    "SELECT instrument_id AS symbol, arg_max(close, ts) AS mark_price FROM bars_daily GROUP BY instrument_id",
)


def _quotes(spark, sf):
    return fx.bars_daily(spark, sf).select(
        F.col("instrument_id").alias("symbol"), "ts", F.col("close").alias("price")
    )


@query(
    "mark_positions",
    f"""SELECT account, symbol, quantity, {sql_nudged("average_price", 3)} AS average_price,
    {sql_nudged("mark_price::DOUBLE * quantity", 2)} AS exposure,
    {sql_nudged("(mark_price::DOUBLE - average_price) * quantity", 2)} AS unrealized_pnl
    FROM final_positions JOIN last_closes USING (symbol)""",
)
def mark_positions(spark, sf):
    held = led.open_positions(_book(spark, sf))
    marked = led.mark_positions(held, led.latest_quotes(_quotes(spark, sf)))
    return marked.select(
        "account", "symbol", "quantity",
        *rounded({"average_price": 3, "exposure": 2, "unrealized_pnl": 2}, nudge=True),
    )


# State of every account at every instant, by looking at each position as of that instant.
view(
    "account_times",
    """
SELECT DISTINCT account, ts FROM fills WHERE (account, symbol, client_order_id) IN
  (SELECT (account, symbol, client_order_id) FROM book)
UNION SELECT DISTINCT h.account, b.ts FROM (SELECT DISTINCT account, symbol FROM book) h
  JOIN bars_daily b ON b.instrument_id = h.symbol""",
)
view(
    "position_changes",
    """
SELECT account, symbol, ts, arg_max(held, n) AS held, arg_max(held * average, n) AS basis,
  arg_max(fees, n) AS fees, arg_max(price, n) AS price FROM book GROUP BY account, symbol, ts""",
)
view(
    "position_values",
    """
SELECT t.account, t.ts, p.symbol, p.held, p.basis, p.fees,
  CASE WHEN b.ts >= p.ts THEN b.close ELSE p.price END AS mark
FROM (SELECT t.account, t.ts, h.symbol FROM account_times t JOIN (SELECT DISTINCT account, symbol FROM book) h
        ON h.account = t.account) t
ASOF JOIN position_changes p ON p.account = t.account AND p.symbol = t.symbol AND t.ts >= p.ts
ASOF LEFT JOIN bars_daily b ON b.instrument_id = t.symbol AND t.ts >= b.ts""",
)
view(
    "account_cash",
    f"""
SELECT account, ts, {CASH} + sum(sum(CASE WHEN side = 'buy' THEN -(price * quantity) - cost
    ELSE price * quantity - cost END)) OVER (PARTITION BY account ORDER BY ts) AS cash,
  sum(sum(realized)) OVER (PARTITION BY account ORDER BY ts) AS realized
FROM book GROUP BY account, ts""",
)
view(
    "snapshot_values",
    f"""
SELECT t.account, t.ts, coalesce(c.cash, {CASH}) AS cash, coalesce(c.realized, 0) AS realized_pnl,
  coalesce(v.exposure, 0) AS exposure, coalesce(v.exposure, 0) - coalesce(v.carried, 0) AS unrealized_pnl
FROM account_times t ASOF LEFT JOIN account_cash c ON c.account = t.account AND t.ts >= c.ts
LEFT JOIN (SELECT account, ts, sum(held * mark::DOUBLE) AS exposure, sum(basis + fees) AS carried
  FROM position_values GROUP BY account, ts) v ON v.account = t.account AND v.ts = t.ts""",
)


def _states(spark, sf):
    book = staged(_book(spark, sf, "client_order_id"), "book")
    return led.snapshots(book, _quotes(spark, sf), GRID, CASH)


@query(
    "snapshot",
    f"""SELECT account, {sql_stamp()} AS ts, CAST(cash AS DOUBLE) AS cash, {sql_nudged("exposure", 2)} AS exposure,
    {sql_nudged("realized_pnl", 1)} AS realized_pnl, {sql_nudged("unrealized_pnl", 1)} AS unrealized_pnl
    FROM snapshot_values""",
)
def snapshot(spark, sf):
    return _states(spark, sf).select(
        "account", stamp().alias("ts"), F.col("cash").cast("double").alias("cash"),
        *rounded({"exposure": 2, "realized_pnl": 1, "unrealized_pnl": 1}, nudge=True),
    )


@query(
    "equity_curve",
    f"""SELECT account, {sql_stamp()} AS ts, round(cash::DOUBLE + exposure, 2) + 0.0::DOUBLE AS equity FROM snapshot_values
    UNION ALL SELECT account, {sql_stamp("min(ts) - INTERVAL 1 SECOND")}, {CASH}::DOUBLE FROM account_times GROUP BY account""",
)
def equity_curve(spark, sf):
    curve = led.equity_curve(_states(spark, sf), CASH)
    return curve.select("account", stamp().alias("ts"), *rounded(["equity"], 2))


@query(
    "day_baseline",
    f"""WITH days AS (SELECT run_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, arg_max(equity, ts) AS close,
      arg_min(equity, ts) AS open FROM equity GROUP BY ALL),
    starts AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY run_id ORDER BY day), open) AS day_start_equity FROM days)
    SELECT e.run_id, {sql_stamp("e.ts")} AS ts, equity, day_start_equity, equity - day_start_equity AS daily_pnl
    FROM equity e JOIN starts s ON s.run_id = e.run_id AND s.day = CAST(e.ts + INTERVAL 330 MINUTE AS DATE)""",
)
def day_baseline(spark, sf):
    rows = led.day_baseline(fx.equity(spark, sf), "run_id")
    return rows.select(
        "run_id", stamp().alias("ts"), "equity", "day_start_equity",
        (F.col("equity") - F.col("day_start_equity")).alias("daily_pnl"),
    )


# --- performance -------------------------------------------------------------------------

view(
    "equity_returns",
    """
SELECT *, CAST(equity AS DOUBLE) / CAST(before AS DOUBLE) - 1 AS ret, 1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE) AS fall
FROM (SELECT *, lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS before,
  max(equity) OVER (PARTITION BY run_id ORDER BY ts) AS peak FROM equity)""",
)
view(
    "perf_values",
    """
SELECT run_id, last / first - 1 AS total_return,
  CASE WHEN n >= 252 THEN power(last / first, 252 / n) - 1 END AS annualized_return,
  sd * sqrt(252) AS annualized_volatility, (mean - rf) * 252 / nullif(sd * sqrt(252), 0) AS sharpe,
  (mean - rf) * sqrt(252) / nullif(down, 0) AS sortino, max_drawdown,
  CASE WHEN n >= 252 THEN power(last / first, 252 / n) - 1 END / nullif(max_drawdown, 0) AS calmar
FROM (SELECT run_id, arg_min(equity, ts)::DOUBLE AS first, arg_max(equity, ts)::DOUBLE AS last,
    count(ret)::DOUBLE AS n, stddev_samp(ret) AS sd, avg(ret) AS mean, any_value(rf) AS rf,
    sqrt(avg(power(least(ret - rf, 0), 2))) AS down, max(fall) AS max_drawdown
  FROM (SELECT *, power(1.02::DOUBLE, 1.0::DOUBLE / 252) - 1 AS rf FROM equity_returns) GROUP BY run_id)""",
)
_METRICS = [
    "total_return", "annualized_return", "annualized_volatility", "sharpe", "sortino",
    "max_drawdown", "calmar",
]


def _metrics(spark, sf):
    return perf.metrics(fx.equity(spark, sf), HOURLY, 252, 0.02)


@query("perf_metrics", f"SELECT run_id, {sql_rounded(_METRICS, 8)} FROM perf_values")
def perf_metrics(spark, sf):
    return _metrics(spark, sf).select("run_id", *rounded(_METRICS, 8))


@query(
    "report_long",
    f"""SELECT run_id, metric, round(value, 8) AS value FROM perf_values
    UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(_METRICS)}))""",
)
def report_long(spark, sf):
    return perf.long_report(_metrics(spark, sf)).select("run_id", "metric", *rounded(["value"], 8))


@query(
    "perf_drawdown",
    "SELECT run_id, round(max(fall), 8) AS max_drawdown FROM equity_returns GROUP BY run_id",
)
def perf_drawdown(spark, sf):
    rows = perf.drawdown(fx.equity(spark, sf), HOURLY)
    return rows.select("run_id", *rounded(["max_drawdown"], 8))


@query(
    "perf_guards",
    """SELECT run_id, array_to_string(list_filter([CASE WHEN first <= 0 THEN 'nonpositive_start' END,
      CASE WHEN lowest < 0 THEN 'negative_or_missing_equity' END,
      CASE WHEN recoveries > 0 THEN 'recovers_from_zero' END], lambda x: x IS NOT NULL), ',') AS reasons,
      zero_starts = 0 AS returns_defined
    FROM (SELECT run_id, arg_min(equity, ts) AS first, min(equity) AS lowest,
      count(*) FILTER (before = 0 AND equity > 0) AS recoveries, count(*) FILTER (before = 0) AS zero_starts
      FROM (SELECT *, lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS before FROM (
        SELECT run_id, ts, CASE WHEN run_id = 'view' AND day(ts) = 9 THEN 0 WHEN run_id = 'click' AND day(ts) = 12
          THEN -equity WHEN run_id = 'error' AND day(ts) = 1 THEN 0 ELSE equity END AS equity FROM equity))
      GROUP BY run_id)""",
)
def perf_guards(spark, sf):
    run, day = F.col("run_id"), F.dayofmonth("ts")
    zero = F.lit(0).cast("decimal(18,2)")
    spoiled = fx.equity(spark, sf).withColumn(
        "equity",
        F.when((run == "view") & (day == 9), zero)
        .when((run == "click") & (day == 12), -F.col("equity"))
        .when((run == "error") & (day == 1), zero)
        .otherwise(F.col("equity")),
    )
    rows = perf.equity_guards(spoiled, HOURLY)
    return rows.select("run_id", F.array_join("reasons", ",").alias("reasons"), "returns_defined")


_TRADE = [
    "win_rate", "loss_rate", "profit_factor", "average_win", "average_loss", "expectancy",
]


@query(
    "perf_trades",
    """SELECT account, round(count(*) FILTER (realized > 0) / count(*), 8) AS win_rate,
      round(count(*) FILTER (realized < 0) / count(*), 8) AS loss_rate,
      round(sum(realized) FILTER (realized > 0) / -sum(realized) FILTER (realized < 0), 6) AS profit_factor,
      round(avg(realized) FILTER (realized > 0), 3) AS average_win,
      round(avg(realized) FILTER (realized < 0), 3) AS average_loss, round(avg(realized), 3) AS expectancy,
      count(*) AS closed_trade_count
    FROM book WHERE side = 'sell' GROUP BY account""",
)
def perf_trades(spark, sf):
    sells = _book(spark, sf, *led.ORDER).filter("side = 'sell'")
    digits = dict(zip(_TRADE, (8, 8, 6, 3, 3, 3), strict=True))
    rows = perf.trade_metrics(sells, "account")
    return rows.select("account", *rounded(digits), "closed_trade_count")


@query(
    "perf_activity",
    f"""SELECT f.account, round(turnover, 6) AS turnover, round(costs, 2) AS costs, round(slippage, 2) AS slippage,
      fill_count, round(average_exposure, 1) AS average_exposure
    FROM (SELECT account, sum(price * quantity)::DOUBLE / {CASH} AS turnover, sum(cost)::DOUBLE AS costs,
        sum(quantity * 0.05)::DOUBLE AS slippage, count(*) AS fill_count FROM book GROUP BY account) f
    JOIN (SELECT account, avg(exposure) AS average_exposure FROM (SELECT account, exposure FROM snapshot_values
        UNION ALL SELECT DISTINCT account, 0 FROM account_times) GROUP BY account) e ON e.account = f.account""",
)
def perf_activity(spark, sf):
    book = staged(_book(spark, sf, "client_order_id"), "book")
    slip = (F.col("quantity") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(24,4)")
    curve = led.equity_curve(led.snapshots(book, _quotes(spark, sf), GRID, CASH), CASH)
    rows = perf.activity(book.withColumn("slippage_cost", slip), curve, float(CASH))
    return rows.select(
        "account", *rounded({"turnover": 6, "costs": 2, "slippage": 2}), "fill_count",
        *rounded(["average_exposure"], 1),
    )


# --- reconciliation ----------------------------------------------------------------------

view(
    "trades_left",
    "SELECT client_order_id, quantity, price, cost AS fees FROM fills WHERE CAST(split_part(client_order_id, '-', 1) AS BIGINT) % 2 = 0",
)
view(
    "trades_right",
    """SELECT client_order_id, quantity + 1 AS quantity, price + 0.01 AS price, cost AS fees FROM fills
    WHERE CAST(split_part(client_order_id, '-', 1) AS BIGINT) % 3 <> 0""",
)


def _trades(spark, sf):
    fills = fx.fills(spark, sf)
    key = F.split_part("client_order_id", F.lit("-"), F.lit(1)).cast("bigint")
    base = ["client_order_id", "quantity", "price", F.col("cost").alias("fees")]
    left = fills.filter(key % 2 == 0).select(*base)
    cent = F.lit("0.01").cast("decimal(4,2)")
    right = fills.filter(key % 3 != 0).select(*base).withColumns(
        {"quantity": F.col("quantity") + 1, "price": (F.col("price") + cent).cast("decimal(18,2)")}
    )
    return left, right


@query(
    "trade_recon",
    """WITH l AS (SELECT client_order_id, count(*) AS n, any_value(quantity) AS quantity, any_value(price) AS price,
      any_value(fees) AS fees FROM trades_left GROUP BY ALL),
    r AS (SELECT client_order_id, count(*) AS n, any_value(quantity) AS quantity, any_value(price) AS price,
      any_value(fees) AS fees FROM trades_right GROUP BY ALL),
    both_ AS (SELECT client_order_id, coalesce(l.n > 1, false) OR coalesce(r.n > 1, false) AS again, l.n AS ln, r.n AS rn,
      l.quantity - r.quantity AS q, CAST(l.price - r.price AS DOUBLE) AS p, CAST(l.fees - r.fees AS DOUBLE) AS f
      FROM l FULL JOIN r USING (client_order_id))
    SELECT client_order_id, CASE WHEN again THEN 'repeated' WHEN rn IS NULL THEN 'only_simulated' WHEN ln IS NULL
      THEN 'only_paper' ELSE 'matched' END AS status, CASE WHEN NOT again THEN q END AS quantity_difference,
      CASE WHEN NOT again THEN p END AS price_difference, CASE WHEN NOT again THEN f END AS fee_difference FROM both_""",
)
def trade_recon(spark, sf):
    rows = rec.compare_trades(*_trades(spark, sf))
    double = lambda c: F.col(c).cast("double").alias(c)
    return rows.select(
        "client_order_id", "status", "quantity_difference", double("price_difference"),
        double("fee_difference"),
    )


@query(
    "recon_duplicates",
    """SELECT CAST(l_orderkey AS VARCHAR) AS client_order_id, count(*) AS copies FROM lineitem
    GROUP BY l_orderkey HAVING count(*) > 1""",
)
def recon_duplicates(spark, sf):
    trades = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("client_order_id")
    )
    return rec.repeated_trades(trades)


@query(
    "recon_sets",
    """SELECT side, count(*) AS n FROM (SELECT CASE WHEN r.price IS NULL THEN 'only_left'
      WHEN l.price IS NULL THEN 'only_right' ELSE 'both' END AS side
    FROM trades_left l FULL JOIN trades_right r USING (client_order_id)) GROUP BY side""",
)
def recon_sets(spark, sf):
    return rec.key_sets(*_trades(spark, sf))


@query(
    "equity_recon",
    """SELECT run_id, round(CAST(arg_max(a - b, ts) AS DOUBLE), 6) AS final_equity_difference,
      round(avg(abs(a - b)::DOUBLE), 6) AS mean_absolute_equity_difference,
      count(*) FILTER (a IS NULL OR b IS NULL) AS unaligned
    FROM (SELECT run_id, ts, l.equity AS a, r.equity AS b FROM equity l FULL JOIN
      (SELECT run_id, ts, equity - exposure / 100 AS equity FROM equity WHERE day(ts) <> 3) r USING (run_id, ts))
    GROUP BY run_id""",
)
def equity_recon(spark, sf):
    left = fx.equity(spark, sf)
    right = left.filter(F.dayofmonth("ts") != 3).withColumn(
        "equity", (F.col("equity") - F.col("exposure") / 100).cast("decimal(20,6)")
    )
    rows = rec.compare_equity(left, right, ["run_id"])
    return rows.select(
        "run_id", *rounded(["final_equity_difference", "mean_absolute_equity_difference"], 6), "unaligned"
    )
