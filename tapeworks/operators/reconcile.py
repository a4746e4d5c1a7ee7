"""Reconciliation of recorded trades and equity series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.rules import copies_per_key

ID = "client_order_id"


def repeated_trades(trades: DataFrame) -> DataFrame:
    """Ids recorded more than once; partial fills must be added up before comparing."""
    return copies_per_key(trades, [ID])


def compare_trades(simulated: DataFrame, paper: DataFrame) -> DataFrame:
    """Matched differences (simulated minus paper), ids on one side only, and repeated ids.

    An id that either side records more than once is ``repeated``: one row, no differences, so copies
    never multiply.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        one = F.first(F.struct("quantity", "price", "fees")).alias(name)
        return df.groupBy(ID).agg(one, (F.count(F.lit(1)) > 1).alias(f"{name}_repeats"))

    both = side(simulated, "s").join(side(paper, "p"), ID, "full")
    c = F.col
    again = F.coalesce(c("s_repeats"), F.lit(False)) | F.coalesce(c("p_repeats"), F.lit(False))
    status = (
        F.when(again, "repeated")
        .when(c("p").isNull(), "only_simulated")
        .when(c("s").isNull(), "only_paper")
        .otherwise("matched")
    )
    return both.select(
        ID,
        status.alias("status"),
        *[
            F.when(~again, c(f"s.{field}") - c(f"p.{field}")).alias(f"{name}_difference")
            for field, name in (("quantity", "quantity"), ("price", "price"), ("fees", "fee"))
        ],
    )


def compare_equity(simulated: DataFrame, paper: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: final and mean absolute difference, and how many instants are unaligned."""
    left = simulated.select(*keys, "ts", F.col("equity").alias("a"))
    right = paper.select(*keys, "ts", F.col("equity").alias("b"))
    both = left.join(right, [*keys, "ts"], "full")
    gap = F.col("a") - F.col("b")
    return both.groupBy(*keys).agg(
        F.max_by(gap, "ts").cast("double").alias("final_equity_difference"),
        F.avg(F.abs(gap).cast("double")).alias("mean_absolute_equity_difference"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unaligned"),
    )


def key_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many distinct ids are on both sides, or on one only."""
    a = left.select(ID).distinct().withColumn("_left", F.lit(True))
    b = right.select(ID).distinct().withColumn("_right", F.lit(True))
    side = F.when(F.col("_right").isNull(), "only_left").when(F.col("_left").isNull(), "only_right")
    both = a.join(b, ID, "full").select(side.otherwise("both").alias("side"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
