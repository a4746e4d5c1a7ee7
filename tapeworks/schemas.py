"""Declared table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

# Vocabularies and versions that stored tables must agree on.
SCHEMA_VERSION = "canonical-v1"
LABEL_VERSION = "targets-v1"
ASSET_CLASSES = ["equity", "future", "option"]
INSTRUMENT_TYPES = ["equity", "future", "option", "etf"]
CONTRACT_TYPES = ["FUTSTK", "FUTIDX", "OPTSTK", "OPTIDX"]
OPTION_TYPES = ["CE", "PE"]
SIDES = ["buy", "sell"]
PRODUCTS = ["equity_delivery", "equity_intraday", "future", "option"]
NAME_PATTERN = r"^\S(?:.*\S)?$"
SYMBOL_PATTERN = r"^[A-Z0-9][A-Z0-9&._-]{0,29}$"
ORDER_ID_PATTERN = r"^[\w.-]{1,100}$"
MARKET_ZONE = "Asia/Kolkata"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CONTRACTS = _struct(
    ("contract_id", T.StringType()),
    ("instrument_type", T.StringType()),
    ("symbol", T.StringType()),
    ("exchange", T.StringType()),
    ("underlying", T.StringType()),
    ("expiry", T.DateType()),
    ("lot_size", T.LongType()),
    ("tick_size", MONEY),
    ("strike", MONEY),
    ("option_type", T.StringType()),
)

BARS = _struct(
    ("asset_class", T.StringType()),
    ("symbol", T.StringType()),
    ("exchange", T.StringType()),
    ("ts", T.TimestampType()),
    ("open", MONEY),
    ("high", MONEY),
    ("low", MONEY),
    ("close", MONEY),
    ("volume", T.LongType()),
    ("underlying", T.StringType()),
    ("expiry", T.DateType()),
    ("strike", MONEY),
    ("option_type", T.StringType()),
    ("open_interest", T.LongType()),
    ("contract", CONTRACTS),
)
REQUIRED_BAR_FIELDS = [
    "asset_class", "symbol", "exchange", "ts", "open", "high", "low", "close", "volume",
]

SESSIONS = _struct(
    ("session_date", T.DateType()),
    ("opens_at", T.TimestampType()),
    ("closes_at", T.TimestampType()),
    ("special", T.BooleanType()),
)
CALENDAR_FILE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("sessions", T.ArrayType(SESSIONS)),
        T.StructField("holidays", T.ArrayType(T.DateType())),
        T.StructField("expiries", T.ArrayType(T.DateType())),
    ]
)
