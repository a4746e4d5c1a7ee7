"""Calendar, contract and event-table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import schemas as S


def read_calendar(
    spark: SparkSession, path: str, *, one_document: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, holidays and expiries of a calendar document, or of one document per line."""
    doc = spark.read.schema(S.CALENDAR_FILE).option("multiLine", one_document).json(path)
    sessions = doc.select(F.explode("sessions").alias("s")).select("s.*")
    sessions = sessions.withColumn("special", F.coalesce("special", F.lit(False)))
    holidays = doc.select(F.explode("holidays").alias("holiday"))
    expiries = doc.select(F.explode("expiries").alias("expiry"))
    return sessions, holidays, expiries


def read_contracts(spark: SparkSession, path: str, *, one_document: bool = True) -> DataFrame:
    return spark.read.schema(S.CONTRACTS).option("multiLine", one_document).json(path)


def latest(rows: DataFrame, limit: int = 100, order: str = "id") -> DataFrame:
    """Newest first; a bounded top-k, so no full sort is kept."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return rows.orderBy(F.desc(order)).limit(limit)


def lookup(wanted: DataFrame, instruments: DataFrame) -> DataFrame:
    """Instrument details per wanted symbol; nulls when the symbol is unknown."""
    return wanted.join(instruments, "symbol", "left")
