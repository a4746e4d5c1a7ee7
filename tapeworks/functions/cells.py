"""Small column helpers: parsing text cells, market-local time, instrument keys."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.schemas import MARKET_ZONE

# Strptime directives and their Spark pattern letters.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "z": "XX", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "p": "a", "j": "DDD",
}


def spark_pattern(strptime_format: str) -> str:
    def one(match: re.Match) -> str:
        directive = match.group(1)
        if directive not in _DIRECTIVES:
            raise ValueError(f"unsupported timestamp directive %{directive}")
        return _DIRECTIVES[directive]

    # Quote literal letters, then translate the directives.
    pieces = re.split(r"(%.)", strptime_format)
    return "".join(
        re.sub(r"%(.)", one, p) if p.startswith("%") else re.sub(r"([A-Za-z]+)", r"'\1'", p)
        for p in pieces
    )


def utc_instant(text: Column, strptime_format: str | None = None) -> Column:
    """Instant of a zone-aware text; null when it does not parse or has no offset."""
    if strptime_format is None:
        aware = text.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$")
        compact = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
        return F.when(aware, compact.try_cast("timestamp"))
    if "%z" not in strptime_format:
        return F.lit(None).cast("timestamp")
    compact = F.regexp_replace(text, r"([+-]\d{2}):(\d{2})$", "$1$2")
    return F.try_to_timestamp(compact, F.lit(spark_pattern(strptime_format)))


def local_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, MARKET_ZONE)


def local_date(ts: Column) -> Column:
    return F.to_date(local_time(ts))


def local_seconds(ts: Column) -> Column:
    """Seconds since local midnight, with the fraction."""
    day = F.lit(86_400_000_000)
    return F.pmod(F.unix_micros(local_time(ts)), day) / F.lit(1e6)


def plain_decimal(value: Column) -> Column:
    """Decimal text without trailing zeros, so 10.0 and 10.00 give the same key."""
    text = value.cast("string")
    return F.when(
        text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    ).otherwise(text)


def instrument_key() -> Column:
    parts = [
        F.col("asset_class"),
        F.col("exchange"),
        F.col("symbol"),
        F.col("underlying"),
        F.col("expiry").cast("string"),
        plain_decimal(F.col("strike")),
        F.col("option_type"),
    ]
    return F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts]))


def failed(checks: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in order; a null condition does not hold.

    ``array_remove`` keeps the conditions inside generated code, which a higher-order filter
    over the array would not.
    """
    names = [F.when(bad, F.lit(name)).otherwise(F.lit("")) for name, bad in checks.items()]
    return F.array_remove(F.array(*names), "")
