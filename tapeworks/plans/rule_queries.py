"""One query per validation rule: the rows it rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.cells import instrument_key
from tapeworks.operators import rules
from tapeworks.plans import fixtures as fx
from tapeworks.plans.registry import query, sql_stamp, stamp


def _flagged(name: str, reasons: list[str], sql_condition: str, source: str = "typed_bars"):
    sql = f"SELECT symbol, bar_time FROM {source} WHERE {sql_condition}"

    @query(name, sql)
    def run(spark, sf):
        raw = fx.raw_bars(spark, sf).withColumn("bar_time", F.col("ts"))
        contracts = fx.contracts(spark, sf) if source == "contract_bars" else None
        checked = rules.validate_bars(raw, contracts=contracts)
        hit = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in reasons]))
        return checked.filter(hit).select("symbol", "bar_time")


_flagged("v_ohlc", ["bad_ohlc"], "low > least(open, close) OR greatest(open, close) > high")
_flagged("v_price", ["bad_price"], "open IS NULL OR open <= 0 OR high IS NULL OR low IS NULL")
_flagged("v_required", ["missing_required"], "raw_close = ''")
_flagged("v_volume", ["bad_volume"], "NOT regexp_full_match(raw_volume, '[0-9]+')")
_flagged("v_timestamp", ["bad_timestamp"], "at_utc IS NULL")
_flagged("v_names", ["bad_name"], "symbol <> trim(symbol) OR symbol = ''")
_flagged(
    "v_enums",
    ["unknown_enum"],
    "asset_class NOT IN ('equity', 'future', 'option') OR option_type NOT IN ('CE', 'PE')",
)
_flagged(
    "v_equity_clean",
    ["equity_with_derivative_fields"],
    "asset_class = 'equity' AND (underlying IS NOT NULL OR expiry IS NOT NULL OR strike IS NOT NULL "
    "OR option_type IS NOT NULL OR raw_oi IS NOT NULL)",
)
_flagged(
    "v_deriv_required",
    ["derivative_fields_missing"],
    "asset_class IN ('future', 'option') AND (underlying IS NULL OR expiry IS NULL)",
)
_flagged(
    "v_expiry",
    ["after_expiry"],
    "asset_class IN ('future', 'option') AND CAST(at_utc + INTERVAL 330 MINUTE AS DATE) > expiry",
)
_flagged(
    "v_option_fields",
    ["option_fields"],
    "(asset_class = 'option' AND (strike IS NULL OR option_type IS NULL)) OR "
    "(asset_class = 'future' AND (strike IS NOT NULL OR option_type IS NOT NULL))",
)
_flagged(
    "v_contract_match",
    ["contract_mismatch"],
    "asset_class IS DISTINCT FROM CASE WHEN instrument_type LIKE 'OPT%' THEN 'option' ELSE 'future' END "
    "OR symbol IS DISTINCT FROM c_symbol OR exchange IS DISTINCT FROM c_exchange "
    "OR underlying IS DISTINCT FROM c_underlying OR expiry IS DISTINCT FROM c_expiry "
    "OR strike IS DISTINCT FROM c_strike OR option_type IS DISTINCT FROM c_option_type",
    "contract_bars",
)
_flagged(
    "v_tick",
    ["tick_misaligned"],
    " OR ".join(
        f"{c} IS NOT NULL AND CASE WHEN tick_size = 0 THEN true ELSE {c} % tick_size <> 0 END"
        for c in ("open", "high", "low", "close")
    ),
    "contract_bars",
)


@query(
    "v_contract_kind",
    """SELECT contract_id FROM contracts WHERE lot_size <= 0 OR tick_size <= 0 OR CASE WHEN instrument_type LIKE 'OPT%'
    THEN strike IS NULL OR option_type IS NULL ELSE strike IS NOT NULL OR option_type IS NOT NULL END""",
)
def v_contract_kind(spark, sf):
    checked = rules.flag(fx.contracts(spark, sf), rules.contract_rules())
    return rules.split(checked)[1].select("contract_id")


@query(
    "instrument_key",
    """SELECT '["' || array_to_string([asset_class, exchange, symbol, coalesce(underlying, ''),
      coalesce(CAST(expiry AS VARCHAR), ''),
      coalesce(CASE WHEN strike = floor(strike) THEN CAST(CAST(strike AS BIGINT) AS VARCHAR) END, ''),
      coalesce(option_type, '')], '","') || '"]' AS instrument_key, count(*) AS n
    FROM typed_bars GROUP BY ALL""",
)
def instrument_keys(spark, sf):
    typed = rules.parse_bars(fx.raw_bars(spark, sf))
    return typed.groupBy(instrument_key().alias("instrument_key")).agg(F.count(F.lit(1)).alias("n"))


# Arrival order for the chronology rules: event ids, with the time moved back now and then.
def _arrivals(spark, sf):
    events = fx.table(spark, sf, "events")
    back = F.when(F.col("event_id") % 17 == 0, F.expr("INTERVAL 3 HOURS")).otherwise(
        F.expr("INTERVAL 0 HOURS")
    )
    ts = F.date_trunc("second", F.col("ts").cast("timestamp") - back)
    return events.select(
        F.col("event_type").alias("instrument_id"), F.col("event_id").alias("row_id"), ts.alias("ts")
    )


ARRIVALS = """(SELECT event_type AS instrument_id, event_id AS row_id, date_trunc('second',
  ts - CASE WHEN event_id % 17 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END) AS ts FROM events)"""


@query(
    "v_chronology",
    f"""SELECT instrument_id, row_id FROM (SELECT *, max(ts) OVER (PARTITION BY instrument_id
    ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {ARRIVALS})
    WHERE ts <= top""",
)
def v_chronology(spark, sf):
    rows = rules.chronology(_arrivals(spark, sf), ["instrument_id"])
    return rows.filter("out_of_order").select("instrument_id", "row_id")


@query(
    "v_duplicates",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
)
def v_duplicates(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    marked = rules.mark_duplicates(lines, ["l_orderkey", "l_linenumber"])
    return (
        marked.filter("duplicate")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


@query(
    "v_lineage",
    """SELECT instrument_id, count(*) AS versions FROM (SELECT DISTINCT instrument_id,
    CASE WHEN volume % 5 = 0 AND instrument_id < 'Brand#2' THEN 'other' ELSE 'fixture' END AS provenance
    FROM bars_daily) GROUP BY instrument_id HAVING count(*) > 1""",
)
def v_lineage(spark, sf):
    other = (F.col("volume") % 5 == 0) & (F.col("instrument_id") < "Brand#2")
    rows = fx.research_daily(spark, sf).withColumn(
        "provenance", F.when(other, "other").otherwise("fixture")
    )
    return rules.mixed_values(rows, ["instrument_id"], ["provenance", "dataset_version", "synthetic"])


@query(
    "v_overlap",
    f"""SELECT {sql_stamp()} AS ts, {sql_stamp("previous_ts")} AS previous_ts FROM (
      SELECT ts, lag(ts) OVER (ORDER BY ts) AS previous_ts FROM (SELECT DISTINCT
        date_trunc('minute', ts) AS ts FROM events))
    WHERE ts < previous_ts + INTERVAL 5 MINUTE""",
)
def v_overlap(spark, sf):
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    rows = fx.table(spark, sf, "events").select(minute.alias("ts"))
    bad = rules.overlapping_times(rows, 300)
    return bad.select(stamp().alias("ts"), stamp("previous_ts").alias("previous_ts"))


@query(
    "v_symbol_unique",
    """SELECT symbol, count(*) AS instruments FROM (SELECT DISTINCT asset_class, exchange, symbol,
    underlying, expiry, strike, option_type FROM typed_bars) GROUP BY symbol HAVING count(*) > 1""",
)
def v_symbol_unique(spark, sf):
    return rules.ambiguous_symbols(rules.parse_bars(fx.raw_bars(spark, sf)))


@query(
    "v_calendar",
    """SELECT day, array_to_string(list_filter([CASE WHEN n > 1 THEN 'duplicate_session' END,
      CASE WHEN holiday IS NOT NULL THEN 'session_on_holiday' END,
      CASE WHEN prev >= opens_at THEN 'overlapping_sessions' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT CAST(s.session_date AS VARCHAR) AS day, opens_at, holiday,
            count(*) OVER (PARTITION BY s.session_date) AS n,
            lag(closes_at) OVER (ORDER BY opens_at, closes_at) AS prev
          FROM (SELECT * FROM sessions UNION ALL
                SELECT session_date, opens_at + INTERVAL 1 HOUR, closes_at - INTERVAL 1 HOUR FROM sessions
                WHERE day(session_date) = 9) s
          LEFT JOIN (SELECT holiday FROM holidays UNION ALL SELECT session_date FROM sessions
                     WHERE day(session_date) = 20) h ON h.holiday = s.session_date)
    WHERE n > 1 OR holiday IS NOT NULL OR prev >= opens_at""",
)
def v_calendar(spark, sf):
    base = fx.sessions(spark, sf)
    hour = F.expr("INTERVAL 1 HOUR")
    extra = base.filter(F.dayofmonth("session_date") == 9).select(
        "session_date", (F.col("opens_at") + hour).alias("opens_at"),
        (F.col("closes_at") - hour).alias("closes_at"),
    )
    off = fx.holidays(spark, sf).unionByName(
        base.filter(F.dayofmonth("session_date") == 20).select(
            F.col("session_date").alias("holiday")
        )
    )
    bad = rules.split(rules.session_rules(base.unionByName(extra), off))[1]
    return bad.select(
        F.col("session_date").cast("string").alias("day"), F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "validate_summary",
    "SELECT count(*) AS rows, count(DISTINCT instrument_id) AS instruments, false AS empty_input FROM bars_daily",
)
def validate_summary(spark, sf):
    return rules.validation_summary(fx.bars_daily(spark, sf))


@query(
    "synthetic_flag",
    """SELECT doc_id, contains(lower(source), 'synthetic') OR doc_id % 10 = 0
      OR contains(lower(lang), 'en') AS synthetic FROM documents""",
)
def synthetic_flag(spark, sf):
    docs = fx.table(spark, sf, "documents")
    name = F.concat(
        F.lit("/feeds/synthetic-dir/"), F.when(F.lower("lang").contains("en"), "Synthetic.csv")
        .otherwise("real.csv"),
    )
    flagged = rules.synthetic_flag(F.col("doc_id") % 10 == 0, F.col("source"), name)
    return docs.select("doc_id", flagged.alias("synthetic"))


_SOWN_BARS = """SELECT * REPLACE (CASE WHEN strike IS NOT NULL AND close LIKE '%7' THEN '-5' ELSE strike END AS strike,
    CASE WHEN expiry IS NOT NULL AND open LIKE '%33' THEN 'soon' ELSE expiry END AS expiry,
    CASE WHEN volume LIKE '%9' THEN low || '001' ELSE low END AS low) FROM raw_bars"""
_ANY_PRICE = " OR ".join(f"({c} IS NULL AND nullif(raw_{c}, '') IS NOT NULL) OR {c} <= 0" for c in ("open", "high", "low", "close"))


@query(
    "quarantine_counts",
    f"""WITH sown AS ({_SOWN_BARS}),
    typed AS (SELECT asset_class, symbol, underlying, option_type, close AS raw_close, volume AS raw_volume,
      open_interest AS raw_oi, strike AS raw_strike, expiry AS raw_expiry, ts AS raw_ts,
      open AS raw_open, high AS raw_high, low AS raw_low,
      CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$')
        THEN CAST(replace(substr(ts, 1, 19), 'T', ' ') AS TIMESTAMP) - INTERVAL 330 MINUTE END AS at_utc,
      TRY_CAST(open AS DECIMAL(18,4)) AS open, TRY_CAST(high AS DECIMAL(18,4)) AS high,
      TRY_CAST(low AS DECIMAL(18,4)) AS low, TRY_CAST(nullif(close, '') AS DECIMAL(18,4)) AS close,
      TRY_CAST(strike AS DECIMAL(18,4)) AS strike, TRY_CAST(expiry AS DATE) AS expiry FROM sown)
    SELECT reason, count(*) AS n FROM (
      SELECT unnest(list_filter([CASE WHEN at_utc IS NULL THEN 'bad_timestamp' END,
        CASE WHEN raw_close = '' THEN 'missing_required' END,
        CASE WHEN {_ANY_PRICE} THEN 'bad_price' END,
        CASE WHEN raw_volume LIKE '%9' THEN 'unsupported_scale' END,
        CASE WHEN NOT regexp_full_match(raw_volume, '[0-9]+') THEN 'bad_volume' END,
        CASE WHEN NOT regexp_full_match(raw_oi, '[0-9]+') THEN 'bad_open_interest' END,
        CASE WHEN raw_expiry IS NOT NULL AND expiry IS NULL THEN 'bad_expiry_date' END,
        CASE WHEN raw_strike IS NOT NULL AND (strike IS NULL OR strike <= 0) THEN 'bad_strike' END,
        CASE WHEN low > least(open, close) OR greatest(open, close) > high THEN 'bad_ohlc' END,
        CASE WHEN symbol <> trim(symbol) THEN 'bad_name' END,
        CASE WHEN asset_class NOT IN ('equity', 'future', 'option') OR option_type NOT IN ('CE', 'PE')
          THEN 'unknown_enum' END,
        CASE WHEN asset_class = 'equity' AND (underlying IS NOT NULL OR expiry IS NOT NULL OR strike IS NOT NULL
          OR option_type IS NOT NULL OR raw_oi IS NOT NULL) THEN 'equity_with_derivative_fields' END,
        CASE WHEN asset_class IN ('future', 'option') AND (underlying IS NULL OR expiry IS NULL)
          THEN 'derivative_fields_missing' END,
        CASE WHEN asset_class IN ('future', 'option') AND CAST(at_utc + INTERVAL 330 MINUTE AS DATE) > expiry
          THEN 'after_expiry' END,
        CASE WHEN asset_class = 'option' AND (strike IS NULL OR option_type IS NULL) OR asset_class = 'future'
          AND (strike IS NOT NULL OR option_type IS NOT NULL) THEN 'option_fields' END], lambda x: x IS NOT NULL)) AS reason
      FROM typed) GROUP BY reason""",
)
def quarantine_counts(spark, sf):
    """Every reason a bar is rejected for, with faults of strike, expiry and scale sown on top."""
    c = F.col
    sown = fx.raw_bars(spark, sf).withColumns(
        {
            "strike": F.when(c("strike").isNotNull() & c("close").endswith("7"), "-5").otherwise(c("strike")),
            "expiry": F.when(c("expiry").isNotNull() & c("open").endswith("33"), "soon").otherwise(c("expiry")),
            "low": F.when(c("volume").endswith("9"), F.concat("low", F.lit("001"))).otherwise(c("low")),
        }
    )
    bad = rules.split(rules.validate_bars(sown))[1]
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
