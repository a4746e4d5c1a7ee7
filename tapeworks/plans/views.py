"""SQL text of the derived tables, in dependency order, for the DuckDB twins."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it refers to, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = sql.strip()
    if re.match(r"WITH\b", body, re.I):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH RECURSIVE {parts},\n{body}"
    return f"WITH RECURSIVE {parts}\n{body}"


view(
    "bars_daily",
    """
SELECT p_brand AS instrument_id, l_shipdate AS ts, arg_min(price, seq_key) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, seq_key) AS close, CAST(sum(quantity) AS BIGINT) AS volume
FROM (SELECT p_brand, l_shipdate, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
             CAST(l_quantity AS BIGINT) AS quantity,
             row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq_key
      FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY p_brand, l_shipdate""",
)
view(
    "bars_hourly",
    """
SELECT event_type AS instrument_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts,
       arg_min(price, seq_key) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, seq_key) AS close, count(*) AS volume
FROM (SELECT event_type, ts, CAST(value AS DECIMAL(18,2)) AS price, row(ts, event_id) AS seq_key
      FROM events)
GROUP BY event_type, date_trunc('hour', ts) + INTERVAL 1 HOUR""",
)
view(
    "research_daily",
    """
SELECT instrument_id, ts, CAST(close AS DOUBLE) AS close, CAST(high AS DOUBLE) AS high,
       CAST(low AS DOUBLE) AS low, CAST(volume AS DOUBLE) AS volume,
       CASE WHEN volume % 7 <> 0 THEN CAST(volume * 10 AS DOUBLE) END AS open_interest,
       CASE WHEN volume % 11 <> 0 THEN CAST(open AS DOUBLE) END AS underlying_price,
       CASE WHEN volume % 13 <> 0 THEN CAST(low AS DOUBLE) END AS strike,
       CASE WHEN volume % 5 <> 0 THEN ts + INTERVAL 30 DAY END AS expiry
FROM bars_daily""",
)
view(
    "numbered",
    """
SELECT *, row_number() OVER w - 1 AS idx, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2
FROM research_daily WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)""",
)
view(
    "moves",
    """
SELECT *, coalesce(greatest(close - c1, 0), 0) AS gain, coalesce(greatest(c1 - close, 0), 0) AS loss,
       CASE WHEN idx = 0 THEN high - low
            ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr
FROM numbered""",
)
# Sequential twin of the recursive indicators: one step per bar.
view(
    "seeds",
    """
SELECT instrument_id, sum(gain) FILTER (idx BETWEEN 1 AND 14) / 14 AS gain_seed,
       sum(loss) FILTER (idx BETWEEN 1 AND 14) / 14 AS loss_seed,
       sum(tr) FILTER (idx <= 13) / 14 AS tr_seed
FROM moves GROUP BY instrument_id""",
)
view(
    "recursive_steps",
    """
SELECT m.instrument_id, m.idx, m.ts, m.close, close AS ema12, close AS ema26,
       CAST(0 AS DOUBLE) AS signal, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l,
       CAST(0 AS DOUBLE) AS a, gain_seed, loss_seed, tr_seed
FROM moves m JOIN seeds s ON m.instrument_id = s.instrument_id WHERE idx = 0
UNION ALL
SELECT m.instrument_id, m.idx, m.ts, m.close,
       m.close * (2.0::DOUBLE / 13) + r.ema12 * (1 - 2.0::DOUBLE / 13),
       m.close * (2.0::DOUBLE / 27) + r.ema26 * (1 - 2.0::DOUBLE / 27),
       ((m.close * (2.0::DOUBLE / 13) + r.ema12 * (1 - 2.0::DOUBLE / 13))
        - (m.close * (2.0::DOUBLE / 27) + r.ema26 * (1 - 2.0::DOUBLE / 27))) * 0.2::DOUBLE
         + r.signal * 0.8::DOUBLE,
       CASE WHEN m.idx < 14 THEN 0 WHEN m.idx = 14 THEN gain_seed ELSE (r.g * 13 + m.gain) / 14 END,
       CASE WHEN m.idx < 14 THEN 0 WHEN m.idx = 14 THEN loss_seed ELSE (r.l * 13 + m.loss) / 14 END,
       CASE WHEN m.idx < 13 THEN 0 WHEN m.idx = 13 THEN tr_seed ELSE (r.a * 13 + m.tr) / 14 END,
       gain_seed, loss_seed, tr_seed
FROM recursive_steps r JOIN moves m ON m.instrument_id = r.instrument_id AND m.idx = r.idx + 1""",
)
view(
    "recursive_values",
    """
SELECT instrument_id, ts, ema12 AS ema_12, ema26 AS ema_26, ema12 - ema26 AS macd,
       signal AS macd_signal, ema12 - ema26 - signal AS macd_histogram,
       CASE WHEN idx >= 14 THEN CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50 ELSE 100 END
            ELSE 100 - 100 / (1 + g / l) END END AS rsi_14,
       CASE WHEN idx >= 13 THEN a END AS atr_14, CASE WHEN idx >= 13 THEN a / close END AS atr_pct
FROM recursive_steps""",
)
view(
    "trailing_values",
    """
SELECT instrument_id, ts, idx, close, volume, open_interest,
  close / c1 - 1 AS return_1, close / lag(close, 5) OVER w - 1 AS return_5,
  close / lag(close, 10) OVER w - 1 AS return_10, close / lag(close, 20) OVER w - 1 AS return_20,
  ln(close / c1) AS log_return_1, ln(close / lag(close, 5) OVER w) AS log_return_5,
  ln(close / lag(close, 10) OVER w) AS log_return_10, ln(close / lag(close, 20) OVER w) AS log_return_20,
  CASE WHEN idx >= 4 THEN avg(close) OVER w5 END AS sma_5,
  CASE WHEN idx >= 9 THEN avg(close) OVER w10 END AS sma_10,
  CASE WHEN idx >= 19 THEN avg(close) OVER w20 END AS sma_20,
  CASE WHEN idx >= 49 THEN avg(close) OVER w50 END AS sma_50,
  CASE WHEN idx >= 19 THEN stddev_samp(close) OVER w20 END AS sd,
  CASE WHEN idx >= 19 THEN (volume - avg(volume) OVER w20) / nullif(stddev_samp(volume) OVER w20, 0)
       END AS volume_zscore_20,
  volume - 2 * lag(volume) OVER w + lag(volume, 2) OVER w AS volume_acceleration,
  CASE WHEN idx >= 20 THEN stddev_samp(ln(close / c1)) OVER w20 END AS realized_volatility_20,
  CASE WHEN idx >= 19 THEN sqrt(avg(power(ln(high / low), 2)) OVER w20 / (4 * ln(2))) END
       AS high_low_volatility_20,
  CASE WHEN idx >= 20 THEN volume / nullif(avg(volume) OVER wprev, 0) END AS volume_ratio_20,
  close / c1 - c1 / c2 AS return_acceleration,
  close - lag(close, 20) OVER w AS momentum_20,
  CASE WHEN idx >= 19 THEN max(high) OVER w20 END AS rolling_high_20,
  CASE WHEN idx >= 19 THEN min(low) OVER w20 END AS rolling_low_20,
  open_interest - lag(open_interest) OVER w AS oi_change,
  (close - c1) * (open_interest - lag(open_interest) OVER w) AS price_oi_relationship,
  close / underlying_price - 1 AS basis,
  (epoch(expiry) - epoch(ts)) / 86400 AS time_to_expiry_days,
  underlying_price / strike AS moneyness
FROM numbered
WINDOW w AS (PARTITION BY instrument_id ORDER BY ts),
  w5 AS (PARTITION BY instrument_id ORDER BY ts ROWS 4 PRECEDING),
  w10 AS (PARTITION BY instrument_id ORDER BY ts ROWS 9 PRECEDING),
  w20 AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING),
  w50 AS (PARTITION BY instrument_id ORDER BY ts ROWS 49 PRECEDING),
  wprev AS (PARTITION BY instrument_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
view(
    "window_values",
    """
SELECT *, (close - (sma_20 - 2 * sd)) / nullif(4 * sd, 0) AS bollinger_position,
  sma_20 + 2 * sd AS bollinger_upper, sma_20 - 2 * sd AS bollinger_lower,
  (close - sma_20) / nullif(sd, 0) AS zscore_20, close / sma_20 - 1 AS ma_distance_20
FROM trailing_values""",
)
view(
    "predictions",
    """
SELECT doc_id, lang, CAST(quality AS BIGINT) AS y,
       CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(1000 AS DOUBLE)) AS p,
       CAST((n_chars % 41) - 20 AS DOUBLE) AS move
FROM labels JOIN documents USING (doc_id)""",
)
view(
    "fills",
    """
SELECT account, client_order_id, symbol, ts, max(side) AS side, max(quantity) AS quantity,
       max(price) AS price, max(cost) AS cost
FROM (SELECT 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS account,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS client_order_id,
        p_brand AS symbol, l_shipdate AS ts,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        CAST(l_quantity AS BIGINT) AS quantity,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
        CAST(round(l_tax * 100, 0) AS DECIMAL(18,2)) AS cost
      FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY account, client_order_id, symbol, ts""",
)
view(
    "equity",
    """
SELECT instrument_id AS run_id, ts, CAST(close + 10000 AS DECIMAL(18,2)) AS equity,
       CAST(volume * close AS DECIMAL(18,2)) AS exposure
FROM bars_hourly""",
)
view(
    "raw_bars",
    """
SELECT * EXCLUDE (ts, open, high, low, close, volume, num, k, cls),
  CASE WHEN k % 211 = 0 THEN 'bond' WHEN cls < 3 THEN 'equity' WHEN cls = 3 THEN 'future'
       ELSE 'option' END AS asset_class,
  CASE WHEN k % 223 = 0 THEN ' BAD' ELSE 'BRAND-' || num END AS symbol, 'NSE' AS exchange,
  strftime(ts + INTERVAL 570 MINUTE, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN k % 227 = 0 THEN '' ELSE '+05:30' END AS ts,
  CASE WHEN k % 239 = 0 THEN '0.00' ELSE CAST(open AS VARCHAR) END AS open,
  CASE WHEN k % 229 = 0 THEN 'NaN' WHEN k % 233 = 0 THEN CAST(low AS VARCHAR)
       ELSE CAST(high AS VARCHAR) END AS high,
  CASE WHEN k % 233 = 0 THEN CAST(high AS VARCHAR) ELSE CAST(low AS VARCHAR) END AS low,
  CASE WHEN k % 293 = 0 THEN '' ELSE CAST(close AS VARCHAR) END AS close,
  CASE WHEN k % 241 = 0 THEN '1.5' WHEN k % 251 = 0 THEN '-1' ELSE CAST(volume AS VARCHAR) END AS volume,
  CASE WHEN cls >= 3 AND k % 257 <> 0 THEN 'UL-' || num END AS underlying,
  CASE WHEN cls >= 3 THEN CASE WHEN k % 263 = 0 THEN '1990-01-01' ELSE '2005-12-31' END END AS expiry,
  CASE WHEN cls = 4 AND k % 269 <> 0 THEN '100.00' WHEN cls = 0 AND k % 271 = 0 THEN '50.00' END AS strike,
  CASE WHEN cls = 4 THEN CASE WHEN k % 277 = 0 THEN 'XX' ELSE 'CE' END
       WHEN cls = 3 AND k % 281 = 0 THEN 'PE' END AS option_type,
  CASE WHEN cls >= 3 THEN CASE WHEN k % 283 = 0 THEN '2.5' ELSE CAST(volume * 10 AS VARCHAR) END END
    AS open_interest
FROM (SELECT *, num % 5 AS cls, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) * 31 + num * 7 AS k
      FROM (SELECT *, CAST(replace(instrument_id, 'Brand#', '') AS BIGINT) AS num FROM bars_daily))""",
)
view(
    "contracts",
    """
SELECT 'C-' || num AS contract_id,
  CASE WHEN num % 5 = 3 THEN 'FUTSTK' ELSE 'OPTSTK' END AS instrument_type,
  'BRAND-' || num AS symbol, 'NSE' AS exchange,
  CASE WHEN num % 7 = 1 THEN 'OTHER' ELSE 'UL-' || num END AS underlying,
  DATE '2005-12-31' AS expiry, CASE WHEN num = 8 THEN 0 ELSE lot END AS lot_size,
  CAST(CASE WHEN num = 18 THEN 0 ELSE 0.05 END AS DECIMAL(18,4)) AS tick_size,
  CASE WHEN num % 5 = 4 AND num <> 9 THEN CAST(100 AS DECIMAL(18,4)) END AS strike,
  CASE WHEN num % 5 = 4 OR num = 13 THEN 'CE' END AS option_type
FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS num, CAST(max(p_size) AS BIGINT) AS lot
      FROM part GROUP BY p_brand) WHERE num % 5 >= 3""",
)
view(
    "typed_bars",
    """
SELECT instrument_id, asset_class, symbol, exchange, ts AS bar_time,
  CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{2}:[0-9]{2})$')
       THEN CAST(replace(substr(ts, 1, 19), 'T', ' ') AS TIMESTAMP) - INTERVAL 330 MINUTE END AS at_utc,
  TRY_CAST(open AS DECIMAL(18,4)) AS open, TRY_CAST(high AS DECIMAL(18,4)) AS high,
  TRY_CAST(low AS DECIMAL(18,4)) AS low, TRY_CAST(nullif(close, '') AS DECIMAL(18,4)) AS close,
  volume AS raw_volume, close AS raw_close, open_interest AS raw_oi,
  underlying, CAST(expiry AS DATE) AS expiry, CAST(strike AS DECIMAL(18,4)) AS strike, option_type
FROM raw_bars""",
)
view(
    "contract_bars",
    """
SELECT b.*, c.contract_id, c.instrument_type, c.symbol AS c_symbol, c.exchange AS c_exchange,
  c.underlying AS c_underlying, c.expiry AS c_expiry, c.strike AS c_strike,
  c.option_type AS c_option_type, c.tick_size
FROM typed_bars b JOIN contracts c ON c.symbol = b.symbol WHERE b.asset_class IN ('future', 'option')""",
)
view(
    "sessions",
    """
SELECT d AS session_date, d + INTERVAL 225 MINUTE AS opens_at, d + INTERVAL 600 MINUTE AS closes_at
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM bars_daily)
WHERE isodow(d) <= 5 AND day(d) <> 1""",
)
view(
    "holidays",
    "SELECT DISTINCT CAST(ts AS DATE) AS holiday FROM bars_daily WHERE day(CAST(ts AS DATE)) = 1",
)
view(
    "session_bars",
    """
SELECT instrument_id, ts + (225 + (volume % 8) * 60) * INTERVAL 1 MINUTE AS ts, open, high, low, close,
       volume FROM bars_daily""",
)
view(
    "risk_orders",
    """
SELECT o_orderkey AS arrival, CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END
         AS order_no, o_custkey AS account, 'BRAND-' || (o_orderkey % 25 + 1) AS symbol,
  CASE WHEN o_orderkey % 47 = 0 THEN 'option' ELSE 'equity' END AS instrument_type,
  CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS quantity,
  CAST(CAST(floor(o_totalprice) AS BIGINT) / 100 AS DECIMAL(18,2)) AS quote_price,
  CASE WHEN o_orderkey % 41 = 0 THEN 'OTHER' ELSE 'BRAND-' || (o_orderkey % 25 + 1) END AS quote_symbol,
  CASE WHEN o_orderkey % 43 = 0 THEN 'etf' WHEN o_orderkey % 47 = 0 THEN 'option' ELSE 'equity' END
    AS quote_type,
  o_orderdate + (225 + (o_orderkey % 9) * 47) * INTERVAL 1 MINUTE AS now,
  o_orderdate + (225 + (o_orderkey % 9) * 47) * INTERVAL 1 MINUTE
    - (o_orderkey % 50 - 5) * INTERVAL 1 SECOND AS quote_ts,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0
       THEN CAST(CAST(floor(o_totalprice) AS BIGINT) / 100 AS DECIMAL(18,2))
       WHEN o_orderstatus = 'F' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) / 100 AS DECIMAL(18,2)) + 5
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) / 100 AS DECIMAL(18,2)) - 5 END AS stop_loss
FROM orders""",
)
view(
    "account_states",
    """
SELECT c_custkey AS account, CAST(c_acctbal * 2 AS DECIMAL(18,2)) AS cash,
  CAST(c_custkey % 50 * 1000 AS DECIMAL(18,2)) AS exposure,
  CAST(c_acctbal * 2 AS DECIMAL(18,2)) + CAST(c_custkey % 50 * 1000 AS DECIMAL(18,2)) AS equity,
  CAST(c_acctbal * 2 AS DECIMAL(18,2)) + CAST(c_custkey % 50 * 1000 AS DECIMAL(18,2))
    + CAST(c_custkey % 60 * 100 AS DECIMAL(18,2)) AS day_start_equity,
  c_custkey % 7 AS open_positions FROM customer""",
)
view(
    "held_positions",
    """
SELECT c_custkey AS account, 'BRAND-' || (c_custkey % 25 + 1) AS symbol, c_custkey % 4 + 1 AS quantity
FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'BRAND-' || ((c_custkey + 5) % 25 + 1), 3 FROM customer WHERE c_custkey % 3 = 1""",
)
view(
    "screen_rows",
    """
SELECT o.*, s.cash, s.exposure, s.equity, s.day_start_equity, s.open_positions, h.quantity AS held,
  row_number() OVER (PARTITION BY order_no ORDER BY arrival) > 1 AS repeated,
  CAST(o.now + INTERVAL 330 MINUTE AS TIMESTAMP) AS local_now, epoch(now) - epoch(quote_ts) AS age,
  quote_price * o.quantity AS amount
FROM risk_orders o LEFT JOIN account_states s ON s.account = o.account
LEFT JOIN held_positions h ON h.account = o.account AND h.symbol = o.symbol""",
)
