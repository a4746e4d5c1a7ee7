"""Classifier metrics over a table of (y, p). Undefined ratios are zero or null as noted."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.series import running


def confusion(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Counts at p >= 0.5 with precision, recall and F1; an undefined ratio counts as zero."""
    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    counts = rows.groupBy(*(groups or [])).agg(
        F.count_if(~hit & ~y).alias("tn"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"),
        F.count_if(hit & y).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counts.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
        }
    )


def ranking(rows: DataFrame) -> DataFrame:
    """ROC AUC and step-wise average precision; null when only one class is present.

    Rows are first counted per distinct score. Scores are then accumulated from the highest
    down, in quantile buckets so that no task sorts all of them.
    """
    scores = rows.groupBy("p").agg(
        # Decimals: products of counts leave the range of a bigint.
        F.sum(F.col("y").cast("bigint")).cast("decimal(19,0)").alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).cast("decimal(19,0)").alias("neg"),
    )
    cut = QuantileDiscretizer(
        numBuckets=1024, inputCol="p", outputCol="_q", relativeError=0.0005
    ).fit(scores)
    falling = cut.transform(scores).withColumn("_minus_p", -F.col("p"))
    bucket = -F.col("_q").cast("bigint")
    steps = running(
        falling, [], ["_minus_p"], bucket, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    sums = steps.agg(
        F.sum(pos).alias("p_all"),
        F.sum(neg).alias("n_all"),
        F.sum(pos.cast("double") * (2 * fp - neg).cast("double")).alias("lost2"),
        F.sum(pos.cast("double") * tp.cast("double") / (tp + fp).cast("double")).alias("precision_sum"),
    )
    both = (F.col("p_all") > 0) & (F.col("n_all") > 0)
    p_all, n_all = F.col("p_all").cast("double"), F.col("n_all").cast("double")
    area = 1 - F.try_divide(F.col("lost2"), 2.0 * p_all * n_all)
    return sums.select(
        F.when(both, area).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("precision_sum"), p_all)).alias("pr_auc"),
    )


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))


# Lower edges of the calibration bins. Each bin ends at edge + 0.2 in double
# arithmetic, so a score of exactly 0.6 is counted in the third and the fourth bin.
CALIBRATION_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8]


def calibration(rows: DataFrame) -> DataFrame:
    edges = F.array(*[F.lit(e) for e in CALIBRATION_EDGES])
    p = F.col("p")
    inside = F.filter(
        edges, lambda e: (p >= e) & F.when(e < 0.8, p < e + F.lit(0.2)).otherwise(p <= 1)
    )
    return (
        rows.withColumn("lower", F.explode(inside))
        .groupBy("lower")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("p").alias("predicted"),
            F.avg("y").alias("observed"),
        )
    )


def consequence(rows: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Mean signalled future return after cost. No portfolio, no fills: not a backtest."""
    if cost_bps < 0:
        raise ValueError("nonnegative costs required")
    net = F.col("future_return") - F.lit(cost_bps / 10000)
    signalled = F.when(F.col("p") >= 0.5, net).otherwise(F.lit(0.0))
    return rows.agg(F.avg(signalled).alias("mean_signal_future_return_after_cost"))


def evaluation_rows(rows: DataFrame, ranges: DataFrame, fold: int, partition: str) -> DataFrame:
    """The saved test range, or everything after the validation labels have ended."""
    if partition not in ("test", "out_of_sample"):
        raise ValueError("partition must be test or out_of_sample")
    part = "test" if partition == "test" else "validation"
    edge = ranges.filter((F.col("fold") == fold) & (F.col("part") == part)).first()
    if edge is None:
        raise ValueError(f"no fold {fold}")
    if partition == "test":
        return rows.filter(F.col("ts").between(F.lit(edge["start"]), F.lit(edge["end"])))
    return rows.filter(F.col("ts") > F.lit(edge["label_end"]))
