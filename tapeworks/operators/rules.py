"""Row and table validation. A rule is a named condition that is true for a bad row.

Rows are never repaired: ``flag`` adds ``reasons``, ``split`` separates good rows from the
quarantine, and ``require_clean`` turns a non-empty quarantine into an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks import schemas as S
from tapeworks.functions.cells import failed, instrument_key, local_date, utc_instant
from tapeworks.functions.series import (
    Grid,
    block_window,
    owned,
    running,
    salted_lookup,
    split_series,
)

PRICES = ["open", "high", "low", "close"]


def flag(df: DataFrame, rules: Mapping[str, Column], column: str = "reasons") -> DataFrame:
    reasons = failed(rules)
    kept = [c for c in df.columns if c != column]
    if column in df.columns:
        reasons = F.array_union(F.col(column), reasons)
    # Generated rather than projected: filters on the reasons are then applied to the finished
    # array instead of being pushed down as a second copy of every rule.
    return df.select(*kept, F.explode(F.array(reasons)).alias(column))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size("reasons") == 0).drop("reasons"), df.filter(F.size("reasons") > 0)


def require_clean(df: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first row that has a reason."""
    ok = F.size("reasons") == 0
    message = F.concat(F.lit("rejected row: "), F.array_join("reasons", ", "))
    return df.filter(ok | F.raise_error(message).isNotNull()).drop("reasons")


# --- rules on raw text cells -------------------------------------------------------------


def parse_bars(raw: DataFrame, timestamp_format: str | None = None) -> DataFrame:
    """Typed canonical columns next to the raw text (kept as ``raw_<name>``)."""
    df = raw.select(
        *[F.nullif(F.col(c), F.lit("")).alias(f"raw_{c}") if c in S.BARS.fieldNames() else F.col(c)
          for c in raw.columns]
    )

    def cell(name: str) -> Column:
        return F.col(f"raw_{name}") if name in raw.columns else F.lit(None).cast("string")

    typed = {
        **{n: cell(n) for n in ("asset_class", "symbol", "exchange", "underlying", "option_type")},
        "ts": utc_instant(cell("ts"), timestamp_format),
        **{n: cell(n).try_cast(S.MONEY) for n in (*PRICES, "strike")},
        **{n: cell(n).try_cast("bigint") for n in ("volume", "open_interest")},
        "expiry": cell("expiry").try_cast("date"),
    }
    for name in typed:
        if name not in raw.columns:
            df = df.withColumn(f"raw_{name}", F.lit(None).cast("string"))
    parsed = F.array(F.struct(*[value.alias(name) for name, value in typed.items()]))
    # Generated so that each cell is parsed once however many rules read it.
    return df.select("*", F.inline(parsed))


def text_rules() -> dict[str, Column]:
    """Rules that need the raw text of a cell."""
    raw = lambda n: F.col(f"raw_{n}")
    exact = "decimal(38,10)"
    missing = F.lit(False)
    for name in S.REQUIRED_BAR_FIELDS:
        missing = missing | raw(name).isNull()
    bad_price, scale = F.lit(False), F.lit(False)
    for name in PRICES:
        bad_price = bad_price | (
            raw(name).isNotNull() & (F.col(name).isNull() | (F.col(name) <= 0))
        )
    for name in (*PRICES, "strike"):
        # In the digits themselves: a cast would round what stands beyond its own scale.
        scale = scale | raw(name).rlike(r"\.[0-9]{4}[0-9]*[1-9]")
        scale = scale | (raw(name).try_cast(exact) != F.col(name).cast(exact))
    whole = r"^[0-9]+$"
    return {
        "missing_required": missing,
        "bad_timestamp": raw("ts").isNotNull() & F.col("ts").isNull(),
        "bad_price": bad_price,
        "unsupported_scale": scale,
        "bad_volume": raw("volume").isNotNull()
        & (~raw("volume").rlike(whole) | F.col("volume").isNull()),
        "bad_open_interest": raw("open_interest").isNotNull()
        & (~raw("open_interest").rlike(whole) | F.col("open_interest").isNull()),
        "bad_expiry_date": raw("expiry").isNotNull() & F.col("expiry").isNull(),
        "bad_strike": raw("strike").isNotNull()
        & (F.col("strike").isNull() | (F.col("strike") <= 0)),
    }


# --- rules on typed bars -----------------------------------------------------------------


def ohlc_bad() -> Column:
    low_body, high_body = F.least("open", "close"), F.greatest("open", "close")
    return (F.col("low") > low_body) | (high_body > F.col("high"))


def names_bad(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(c).rlike(S.NAME_PATTERN)
    return bad


def enum_bad(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def typed_rules(with_contract: bool = False) -> dict[str, Column]:
    c = F.col
    equity = c("asset_class") == "equity"
    option, future = c("asset_class") == "option", c("asset_class") == "future"
    derivative = option | future
    extra = F.coalesce(
        c("underlying"),
        c("expiry").cast("string"),
        c("strike").cast("string"),
        c("option_type"),
        c("open_interest").cast("string"),
        *([c("contract.contract_id")] if with_contract else []),
    )
    rules = {
        "bad_ohlc": ohlc_bad(),
        "bad_name": names_bad("symbol", "exchange")
        | F.coalesce(names_bad("underlying"), F.lit(False)),
        "unknown_enum": enum_bad("asset_class", S.ASSET_CLASSES)
        | enum_bad("option_type", S.OPTION_TYPES),
        "equity_with_derivative_fields": equity & extra.isNotNull(),
        "derivative_fields_missing": derivative & (c("underlying").isNull() | c("expiry").isNull()),
        "after_expiry": derivative & (local_date(c("ts")) > c("expiry")),
        "option_fields": (option & (c("strike").isNull() | c("option_type").isNull()))
        | (future & (c("strike").isNotNull() | c("option_type").isNotNull())),
    }
    if with_contract:
        rules |= {
            "contract_mismatch": derivative & contract_disagrees(),
            "tick_misaligned": derivative & tick_misaligned(c("contract.tick_size")),
        }
    return rules


def contract_disagrees(contract: str = "contract") -> Column:
    """A present contract reference must agree with the bar on all identity fields."""
    ref = lambda n: F.col(f"{contract}.{n}")
    kind = F.when(ref("instrument_type").startswith("OPT"), "option").otherwise("future")
    same = F.col("asset_class").eqNullSafe(kind)
    for name in ("symbol", "exchange", "underlying", "expiry", "strike", "option_type"):
        same = same & F.col(name).eqNullSafe(ref(name))
    return ref("contract_id").isNotNull() & ~same


def tick_misaligned(tick: Column) -> Column:
    """A price that is no whole number of ticks; of a tick of zero, none is."""
    bad = F.lit(False)
    for name in PRICES:
        off = F.coalesce(F.try_mod(F.col(name), tick) != 0, F.lit(True))
        bad = bad | (F.col(name).isNotNull() & off)
    return tick.isNotNull() & bad


def contract_rules() -> dict[str, Column]:
    c = F.col
    option = c("instrument_type").startswith("OPT")
    both = c("strike").isNotNull() & c("option_type").isNotNull()
    any_ = c("strike").isNotNull() | c("option_type").isNotNull()
    return {
        "unknown_enum": enum_bad("instrument_type", S.CONTRACT_TYPES)
        | enum_bad("option_type", S.OPTION_TYPES),
        "option_fields": (option & ~both) | (~option & any_),
        "nonpositive_size": (c("lot_size") <= 0) | (c("tick_size") <= 0) | (c("strike") <= 0),
        "missing_required": c("contract_id").isNull() | c("expiry").isNull()
        | c("lot_size").isNull() | c("tick_size").isNull(),
    }


def validate_bars(
    raw: DataFrame, timestamp_format: str | None = None, contracts: DataFrame | None = None
) -> DataFrame:
    """Parse raw text bars and collect every row-level reason."""
    df = parse_bars(raw, timestamp_format)
    if contracts is not None:
        ref = contracts.select(
            F.col("symbol"), F.struct(*S.CONTRACTS.fieldNames()).alias("contract")
        )
        df = df.join(ref, "symbol", "left").withColumn(
            "contract", F.when(F.col("asset_class") != "equity", F.col("contract"))
        )
    df = flag(df, text_rules() | typed_rules(contracts is not None))
    return df.drop(*[n for n in df.columns if n.startswith("raw_")])


# --- rules that look at several rows -----------------------------------------------------


def chronology(rows: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Adds ``out_of_order``: the time does not exceed every earlier time of the same key."""
    bucket = F.shiftright(F.col(row_id).cast("bigint"), 16)
    seen = running(
        rows, keys, [row_id], bucket, {"_latest": ("max", F.col("ts"))}, include_current=False
    )
    late = F.coalesce(F.col("ts") <= F.col("_latest"), F.lit(False))
    return seen.withColumn("out_of_order", late).drop("_latest")


def copies_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present more than once. Counting is partial before the shuffle, so one key with
    very many copies costs one row per input partition."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def mark_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = salted_lookup(rows, copies_per_key(rows, keys), keys)
    return joined.withColumn("duplicate", F.col("copies").isNotNull()).drop("copies")


def mixed_values(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups that carry more than one combination of ``columns``."""
    combos = rows.select(*keys, F.struct(*columns).alias("_combo")).distinct()
    grouped = combos.groupBy(*keys) if keys else combos.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("versions")).filter("versions > 1")


def overlapping_times(rows: DataFrame, bar_seconds: int) -> DataFrame:
    """Distinct times that start before the previous one has closed, over the whole set."""
    grid = Grid(bar_seconds=bar_seconds)
    times = rows.select("ts").distinct().withColumn("_set", F.lit(0))
    cut = split_series(times, ["_set"], grid.bucket("ts"), before=1, block_rows=grid.block_rows)
    cut = cut.withColumn("previous_ts", F.lag("ts").over(block_window(["_set"], "ts")))
    gap = F.unix_micros("ts") - F.unix_micros("previous_ts")
    return owned(cut).filter(gap < F.lit(bar_seconds * 1_000_000))


def ambiguous_symbols(rows: DataFrame) -> DataFrame:
    keyed = rows.select("symbol", instrument_key().alias("instrument_key")).distinct()
    return (
        keyed.groupBy("symbol").agg(F.count(F.lit(1)).alias("instruments")).filter("instruments > 1")
    )


def validation_summary(rows: DataFrame) -> DataFrame:
    """Row and instrument counts; strict callers treat zero rows as an error."""
    return (
        rows.groupBy("instrument_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("instruments"),
        )
        .withColumn("empty_input", F.col("rows") == 0)
    )


def session_rules(sessions: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar faults per session. One row per trading date, so the table stays small."""
    c = F.col
    repeated = sessions.groupBy("session_date").agg((F.count(F.lit(1)) > 1).alias("_repeat"))
    closed = holidays.select(F.col("holiday").alias("session_date")).distinct()
    closed = closed.withColumn("_holiday", F.lit(True))
    df = sessions.join(repeated, "session_date").join(closed, "session_date", "left")
    df = df.withColumn("_year", F.lit(0))
    grid = Grid(bar_seconds=86400)
    cut = split_series(df, ["_year"], grid.bucket("opens_at"), before=1)
    w = block_window(["_year"], "opens_at", "closes_at")
    cut = cut.withColumn("previous_close", F.lag("closes_at").over(w))
    cut = flag(
        cut,
        {
            "opens_after_close": c("opens_at") >= c("closes_at"),
            "date_mismatch": (local_date(c("opens_at")) != c("session_date"))
            | (local_date(c("closes_at")) != c("session_date")),
            "duplicate_session": c("_repeat"),
            "session_on_holiday": c("_holiday"),
            "overlapping_sessions": c("previous_close") >= c("opens_at"),
        },
    )
    return owned(cut)


def label_rules() -> dict[str, Column]:
    c = F.col
    return {
        "label_end_not_after": c("label_end") <= c("ts"),
        "bad_horizon": c("horizon") < 1,
        "not_binary": ~c("direction").isin(0, 1) | ~c("target").isin(0, 1),
        "bad_barrier": (c("upper_barrier") <= 0)
        | ~((c("lower_barrier") > 0) & (c("lower_barrier") < 1)),
        "unknown_enum": enum_bad("barrier", ["upper", "lower", "neither", "ambiguous"]),
    }


def order_rules() -> dict[str, Column]:
    c = F.col
    return {
        "bad_order_id": ~c("client_order_id").rlike(S.ORDER_ID_PATTERN),
        "bad_symbol": ~c("symbol").rlike(S.SYMBOL_PATTERN),
        "bad_side": c("side").isNull() | enum_bad("side", S.SIDES),
        "bad_quantity": c("quantity").isNull() | (c("quantity") <= 0)
        | (c("quantity") != F.floor(c("quantity"))),
        "bad_stop": c("stop_loss") <= 0,
        "limit_price_mismatch": (c("order_type") == "limit") != c("limit_price").isNotNull(),
        "bad_limit": c("limit_price") <= 0,
        "unknown_product": enum_bad("product", S.PRODUCTS),
        "unknown_enum": enum_bad("instrument_type", S.INSTRUMENT_TYPES)
        | enum_bad("order_type", ["market", "limit"]),
    }


def feature_rules(model_features: Sequence[str], version: str) -> dict[str, Column]:
    infinite = F.lit(False)
    for name in model_features:
        value = F.col(name)
        infinite = infinite | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return {
        "feature_version_mismatch": ~F.col("feature_version").eqNullSafe(F.lit(version)),
        "nonfinite_features": infinite,
    }


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise ValueError(f"feature schema mismatch: {absent}")


def synthetic_flag(declared: Column, provider: Column, file_name: Column) -> Column:
    return (
        declared
        | F.lower(provider).contains("synthetic")
        | F.lower(F.regexp_extract(file_name, r"([^/]*)$", 1)).contains("synthetic")
    )


def held_quotes_ok(positions: DataFrame, quotes: DataFrame, max_age_seconds: int) -> DataFrame:
    """Held positions with their quote: present, equity, and 0 <= age <= max_age."""
    c = F.col
    age = (F.unix_micros("now") - F.unix_micros("quote_ts")) / F.lit(1e6)
    joined = positions.join(quotes, "symbol", "left")
    return joined.withColumn(
        "quote_ok",
        c("quote_ts").isNotNull()
        & (c("quote_type") == "equity")
        & (age >= 0)
        & (age <= max_age_seconds),
    )
