"""Scan, sink and manifest queries. Files are written from the given tables, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks import schemas as S
from tapeworks.functions.cells import utc_instant
from tapeworks.operators import rules
from tapeworks.plans import fixtures as fx
from tapeworks.plans.registry import query, rounded, sql_stamp, stamp
from tapeworks.session import scratch_path
from tapeworks.sources import bars as src
from tapeworks.sources import reference as ref
from tapeworks.sources import sinks

MAPPING = src.CsvMapping(
    provider="SYNTHETIC-fixture",
    columns={
        "symbol": "Ticker", "ts": "ClosedAt", "open": "O", "high": "H", "low": "L", "close": "C",
        "volume": "Qty",
    },
    defaults={"asset_class": "equity", "exchange": "NSE"},
    delimiter=";",
)


def _feed(spark, sf) -> str:
    """A delimited feed of every daily bar, written under the shared scratch folder."""
    raw = fx.raw_bars(spark, sf)
    path = scratch_path(spark, "feed")
    header = {v: k for k, v in MAPPING.columns.items()}
    raw.select(*[F.coalesce(F.col(k), F.lit("")).alias(h) for h, k in header.items()]).write.option(
        "header", True
    ).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("emptyValue", "").csv(path)
    return path


@query(
    "scan_csv_mapped",
    """SELECT 'equity' AS asset_class, symbol, 'NSE' AS exchange, ts AS bar_time, open, high, low,
    nullif(close, '') AS close, volume FROM raw_bars""",
)
def scan_csv_mapped(spark, sf):
    rows = src.scan_csv(spark, _feed(spark, sf), MAPPING)
    cells = ("open", "high", "low", "close", "volume")
    return rows.filter(~F.col("bad_structure")).select(
        "asset_class", "symbol", "exchange", F.col("ts").alias("bar_time"), *cells
    )


@query(
    "scan_csv_rejects",
    """SELECT day(CAST(substr(ts, 1, 10) AS DATE)) IN (3, 5, 7) AS bad_structure, count(*) AS lines
    FROM raw_bars GROUP BY ALL""",
)
def scan_csv_rejects(spark, sf):
    """Lines with a missing or extra cell or a stray quote, made from every bar's feed line."""
    raw = fx.raw_bars(spark, sf)
    path = scratch_path(spark, "broken")
    cells = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    line = F.concat_ws(";", *[F.coalesce(F.col(c), F.lit("")) for c in cells])
    day = F.dayofmonth(F.substring("ts", 1, 10).cast("date"))
    broken = (
        F.when(day == 3, F.concat(line, F.lit(";9")))
        .when(day == 5, F.regexp_replace(line, ";[^;]*$", ""))
        .when(day == 7, F.concat(F.lit('"'), F.regexp_replace(line, ";", '"x;', )))
        .otherwise(line)
    )
    header = spark.createDataFrame([(";".join(MAPPING.columns[c] for c in cells),)], "value string")
    header.coalesce(1).write.text(path)
    raw.select(broken.alias("value")).write.mode("append").text(path)
    spec = src.scan_csv(spark, _with_header(spark, path, ";".join(MAPPING.columns[c] for c in cells)), MAPPING)
    return spec.groupBy("bad_structure").agg(F.count(F.lit(1)).alias("lines"))


def _with_header(spark, path: str, header: str) -> str:
    """Give every part file the header line by rewriting lines through the text writer."""
    lines = spark.read.text(path).filter(F.col("value") != header)
    out = scratch_path(spark, "broken-headed")
    # The CSV writer only adds the header; with a separator that never occurs, lines pass as is.
    lines.select(F.col("value").alias(header)).write.option("header", True).option(
        "sep", "\u0001"
    ).option("quote", "\u0000").option("escapeQuotes", False).csv(out)
    return out


@query(
    "ts_parse_utc",
    f"""SELECT symbol, ts AS bar_time, {sql_stamp("at_utc")} AS utc_time
    FROM (SELECT b.symbol, b.ts, t.at_utc FROM raw_bars b JOIN typed_bars t
          ON t.bar_time = b.ts AND t.instrument_id = b.instrument_id)""",
)
def ts_parse_utc(spark, sf):
    at = utc_instant(F.col("ts"))
    return fx.raw_bars(spark, sf).select(
        "symbol", F.col("ts").alias("bar_time"), stamp(at).alias("utc_time")
    )


@query("inspect_head", "SELECT * FROM (SELECT min(symbol) AS first_symbol, 5 AS shown FROM raw_bars WHERE symbol = 'BRAND-1')")
def inspect_head(spark, sf):
    """First rows of a scan, reduced to what does not depend on file order."""
    raw = fx.raw_bars(spark, sf).filter(F.col("symbol") == "BRAND-1")
    head = src.inspect(raw, 5)
    return head.agg(
        F.min("symbol").alias("first_symbol"), F.count(F.lit(1)).cast("int").alias("shown")
    )


def _canonical(spark, sf):
    """Clean typed bars: the good side of the validation."""
    checked = rules.validate_bars(fx.raw_bars(spark, sf))
    good, _ = rules.split(checked)
    return good


CLEAN = """(SELECT * FROM typed_bars WHERE asset_class <> 'bond' AND symbol <> ' BAD' AND at_utc IS NOT NULL
  AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND low <= least(open, close)
  AND greatest(open, close) <= high AND regexp_full_match(raw_volume, '[0-9]+')
  AND (raw_oi IS NULL OR regexp_full_match(raw_oi, '[0-9]+'))
  AND CASE asset_class
      WHEN 'equity' THEN underlying IS NULL AND expiry IS NULL AND strike IS NULL
           AND option_type IS NULL AND raw_oi IS NULL
      ELSE underlying IS NOT NULL AND expiry IS NOT NULL
           AND CAST(at_utc + INTERVAL 330 MINUTE AS DATE) <= expiry
           AND CASE asset_class WHEN 'option' THEN strike IS NOT NULL AND option_type = 'CE'
               ELSE strike IS NULL AND option_type IS NULL END END)"""
CANONICAL_SQL = f"""SELECT asset_class, symbol, {sql_stamp("at_utc")} AS ts, open, high, low, close,
    CAST(raw_volume AS BIGINT) AS volume, CAST(raw_oi AS BIGINT) AS open_interest,
    CAST(expiry AS VARCHAR) AS expiry FROM {CLEAN}"""
_SHOWN = ["asset_class", "symbol", "open", "high", "low", "close", "volume", "open_interest"]


def _show(rows):
    return rows.select(*_SHOWN, stamp().alias("ts"), F.col("expiry").cast("string").alias("expiry"))


@query("scan_jsonl", CANONICAL_SQL)
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    sinks.write_json_lines(_canonical(spark, sf), path)
    rows = src.scan_json_lines(spark, path)
    return _show(rows.filter(F.col("malformed").isNull()))


@query("scan_parquet", CANONICAL_SQL)
def scan_parquet(spark, sf):
    path = scratch_path(spark, "bars")
    sinks.write_bars(_canonical(spark, sf).drop("instrument_id"), path)
    return _show(src.scan_parquet(spark, path))


@query(
    "sink_partitioned",
    f"""SELECT asset_class, year(at_utc) AS year, month(at_utc) AS month, count(*) AS n,
    min(close) AS low_close, max(close) AS high_close FROM {CLEAN} GROUP BY ALL""",
)
def sink_partitioned(spark, sf):
    path = scratch_path(spark, "bars")
    sinks.write_bars(_canonical(spark, sf).drop("instrument_id"), path)
    return (
        src.scan_parquet(spark, path)
        .groupBy("asset_class", F.col("year").cast("bigint").alias("year"),
                 F.col("month").cast("bigint").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("close").alias("low_close"),
            F.max("close").alias("high_close"),
        )
    )


@query("bars_sorted", f"SELECT instrument_id, {sql_stamp()} AS ts, close FROM bars_daily")
def bars_sorted(spark, sf):
    rows = src.sorted_bars(fx.bars_daily(spark, sf))
    return rows.select("instrument_id", stamp().alias("ts"), "close")


@query(
    "bars_range",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, close, volume FROM bars_daily
    WHERE instrument_id = 'Brand#12' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-07-01'""",
)
def bars_range(spark, sf):
    bars = fx.bars_daily(spark, sf).withColumn("symbol", F.col("instrument_id"))
    rows = src.bars_between(bars, "Brand#12", "1996-01-01", "1998-07-01")
    return rows.select("instrument_id", stamp().alias("ts"), "close", "volume")


@query(
    "window_warmup",
    """SELECT instrument_id, CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 'warmup' ELSE 'test' END AS phase,
    count(*) AS n, max(close) AS top FROM bars_daily WHERE ts <= TIMESTAMP '2000-06-30' GROUP BY ALL""",
)
def window_warmup(spark, sf):
    rows = src.test_window(fx.bars_daily(spark, sf), "1997-01-01", "2000-06-30")
    warm, test = rows.filter("phase = 'warmup'"), rows.filter("phase = 'test'")
    both = warm.unionByName(test)
    return both.groupBy("instrument_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.max("close").alias("top")
    )


@query(
    "calendar_load",
    f"""SELECT CAST(session_date AS VARCHAR) AS day, {sql_stamp("opens_at")} AS opens_at, 'session' AS kind
    FROM sessions UNION ALL SELECT CAST(holiday AS VARCHAR), NULL, 'holiday' FROM holidays""",
)
def calendar_load(spark, sf):
    path = scratch_path(spark, "calendar")
    sessions = fx.sessions(spark, sf).withColumn("special", F.lit(False))
    iso = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    sessions = sessions.withColumns(
        {c: F.date_format(c, iso) for c in ("opens_at", "closes_at")}
    )
    # One document per year, so at most 366 sessions each.
    per_year = sessions.groupBy(F.year("session_date").alias("y")).agg(
        F.collect_list(F.struct("session_date", "opens_at", "closes_at", "special")).alias("sessions")
    )
    off = fx.holidays(spark, sf).groupBy(F.year("holiday").alias("y")).agg(
        F.collect_list("holiday").alias("holidays")
    )
    docs = per_year.join(off, "y", "full").withColumn("source", F.lit("fixture")).drop("y")
    docs.write.json(path)
    loaded, holidays, _ = ref.read_calendar(spark, path, one_document=False)
    days = loaded.select(
        F.col("session_date").cast("string").alias("day"),
        stamp("opens_at").alias("opens_at"),
        F.lit("session").alias("kind"),
    )
    return days.unionByName(
        holidays.select(
            F.col("holiday").cast("string").alias("day"),
            F.lit(None).cast("string").alias("opens_at"),
            F.lit("holiday").alias("kind"),
        )
    )


@query(
    "contracts_load",
    """SELECT contract_id, instrument_type, symbol, underlying, CAST(expiry AS VARCHAR) AS expiry,
    lot_size, tick_size, strike, option_type FROM contracts""",
)
def contracts_load(spark, sf):
    path = scratch_path(spark, "contracts")
    fx.contracts(spark, sf).write.json(path)
    rows = ref.read_contracts(spark, path, one_document=False)
    return rows.withColumn("expiry", F.col("expiry").cast("string")).drop("exchange")


@query(
    "latest_events",
    "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100",
)
def latest_events(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    return ref.latest(rows, 100, "event_id")


@query(
    "symbol_lookup",
    """SELECT DISTINCT b.symbol, c.contract_id, c.lot_size FROM raw_bars b
    LEFT JOIN contracts c ON c.symbol = b.symbol""",
)
def symbol_lookup(spark, sf):
    wanted = fx.raw_bars(spark, sf).select("symbol").distinct()
    return ref.lookup(wanted, fx.contracts(spark, sf)).select("symbol", "contract_id", "lot_size")


@query(
    "manifest_stats",
    f"""SELECT count(*) AS row_count, {sql_stamp("min(ts)")} AS first_timestamp,
    {sql_stamp("max(ts)")} AS last_timestamp, count(DISTINCT instrument_id) AS instrument_count
    FROM bars_daily""",
)
def manifest_stats(spark, sf):
    stats = sinks.import_statistics(fx.bars_daily(spark, sf))
    return stats.select(
        "row_count",
        stamp("first_timestamp").alias("first_timestamp"),
        stamp("last_timestamp").alias("last_timestamp"),
        "instrument_count",
    )


_CELLS = ["close", "high", "instrument_id", "low", "open", "ts", "volume"]
_ROW_TEXT = " || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _CELLS
)


_ROOT = f"""SELECT count(*) AS row_count, sha256(count(*) || ':'
      || CAST(sum(CAST('0x' || substr(d, 1, 15) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) || ':'
      || CAST(sum(CAST('0x' || substr(d, 16, 15) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)) AS data_sha256
    FROM (SELECT sha256({_ROW_TEXT}) AS d FROM bars_daily)"""
_MAPPING_TEXT = str(sorted(MAPPING.columns.items())).replace("'", "''")


@query(
    "dataset_fingerprint",
    f"""SELECT row_count, data_sha256, sha256('{_MAPPING_TEXT}') AS mapping_sha256,
      sha256('{S.SCHEMA_VERSION}:' || data_sha256 || ':' || sha256('{_MAPPING_TEXT}') || ':True') AS import_id
    FROM ({_ROOT})""",
)
def dataset_fingerprint(spark, sf):
    return sinks.fingerprint(fx.bars_daily(spark, sf), str(sorted(MAPPING.columns.items())), True)


_LATEST = "(SELECT instrument_id, ts, volume FROM bars_daily ORDER BY ts DESC, instrument_id DESC LIMIT 1)"


@query(
    "manifest_verify",
    f"""SELECT 'equity' AS asset_class, year(ts) AS year, month(ts) AS month, field, 1 AS n
    FROM {_LATEST}, (SELECT unnest(['a', 'b']) AS field)""",
)
def manifest_verify(spark, sf):
    """The stored manifest of an import against a copy of which one bar has another volume."""
    bars = fx.bars_daily(spark, sf).select(
        F.lit("equity").alias("asset_class"), F.col("instrument_id").alias("symbol"), F.lit("NSE").alias("exchange"),
        *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("open", "high", "low", "close")], "ts", "volume",
    )
    path, other, kept = (scratch_path(spark, n) for n in ("import", "copy", "leaves"))
    sinks.write_bars(bars, path)
    sinks.store_manifest(spark, path, kept)
    last = bars.agg(F.max(F.struct("ts", "symbol"))).scalar()
    changed = F.struct("ts", "symbol") == last
    sinks.write_bars(bars.withColumn("volume", F.when(changed, F.col("volume") + 1).otherwise(F.col("volume"))), other)
    found = sinks.verify_import(spark, other, kept, full=True)
    return found.groupBy(*sinks.PARTITION, "field").agg(F.count("*").cast("int").alias("n"))


@query(
    "latest_positions",
    f"""SELECT account, symbol, {sql_stamp("max(ts)")} AS ts, arg_max(price, client_order_id) AS price
    FROM (SELECT *, max(ts) OVER (PARTITION BY account, symbol) AS top FROM fills)
    WHERE ts = top GROUP BY account, symbol""",
)
def latest_positions(spark, sf):
    rows = fx.fills(spark, sf).withColumn("version", F.struct("ts", "client_order_id"))
    current = sinks.latest_per_key(rows, ["account", "symbol"], "version")
    return current.select("account", "symbol", stamp().alias("ts"), "price")


@query(
    "daily_pnl",
    """SELECT run_id, trading_day, equity, day_start_equity, equity - day_start_equity AS daily_pnl FROM (
    SELECT *, coalesce(lag(equity) OVER (PARTITION BY run_id ORDER BY trading_day), opening) AS day_start_equity
    FROM (SELECT run_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS trading_day,
      arg_max(equity, ts) AS equity, arg_min(equity, ts) AS opening FROM equity GROUP BY ALL))""",
)
def daily_pnl(spark, sf):
    from tapeworks.operators.ledger import day_baseline

    rows = day_baseline(fx.equity(spark, sf), key="run_id")
    days = rows.groupBy("run_id", F.col("trading_day").cast("string").alias("trading_day")).agg(
        F.max_by("equity", "ts").alias("equity"), F.max("day_start_equity").alias("day_start_equity")
    )
    return days.withColumn("daily_pnl", F.col("equity") - F.col("day_start_equity"))


@query("event_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_append(spark, sf):
    """Append-only audit table written in two batches, then read back."""
    path = scratch_path(spark, "audit")
    events = fx.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    sinks.append_events(events.filter("event_type in ('click', 'view')"), path)
    sinks.append_events(events.filter("event_type not in ('click', 'view')"), path)
    return sinks.read_table(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "research_bars",
    f"""SELECT symbol AS instrument_id, {sql_stamp("at_utc")} AS ts, CAST(close AS DOUBLE) AS close,
    CAST(raw_volume AS DOUBLE) AS volume, CAST(raw_oi AS DOUBLE) AS open_interest,
    CAST(strike AS DOUBLE) AS strike, 'fixture' AS provenance FROM {CLEAN}""",
)
def research_bars(spark, sf):
    bars = _canonical(spark, sf).withColumn("instrument_id", F.col("symbol"))
    rows = src.research_bars(bars, "fixture", "v1", True)
    return rows.select(
        "instrument_id", stamp().alias("ts"), *rounded(["close", "volume", "open_interest", "strike"]),
        "provenance",
    )
