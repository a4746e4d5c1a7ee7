"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans import (  # noqa: F401
    indicator_queries,
    learning_queries,
    ledger_queries,
    rule_queries,
    source_queries,
    stream_queries,
    trading_queries,
)
from tapeworks.functions.series import DAILY
from tapeworks.operators.features import feature_frame
from tapeworks.operators.labels import add_labels
from tapeworks.plans.fixtures import research_daily
from tapeworks.plans.registry import QUERIES, SQL, rounded
from tapeworks.session import tune

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their short features and the five-bar return that followed."""
    bars = research_daily(tune(spark), sf_dir)
    df = add_labels(feature_frame(bars, DAILY, after=5), 5, 0.0, 0.02, 0.01)
    rows = df.filter(F.col("_own"))
    columns = ["return_1", "sma_5", "sma_20", "zscore_20", "future_return"]
    return rows.select("instrument_id", "ts", *rounded(columns))
