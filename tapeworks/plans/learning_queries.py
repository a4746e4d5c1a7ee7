"""Label, split, model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.series import DAILY
from tapeworks.operators import evaluation as ev
from tapeworks.operators import labels, models, rules, splits
from tapeworks.operators.features import build_features
from tapeworks.plans import fixtures as fx
from tapeworks.plans.indicator_queries import feature_digits
from tapeworks.plans.registry import query, rounded, sql_rounded, sql_stamp, stamp
from tapeworks.plans.views import view
from tapeworks.session import scratch_path, staged
from tapeworks.sources import sinks

HORIZON, THRESHOLD, UPPER, LOWER = 5, 0.05, 0.6, 0.5

view(
    "label_values",
    f"""
SELECT instrument_id, ts, label_end, future_return, CAST(future_return > 0 AS INTEGER) AS direction,
  CAST(future_return > {THRESHOLD} AS INTEGER) AS target,
  CASE WHEN least(first_up, first_down) > {HORIZON} THEN 'neither' WHEN first_up = first_down
       THEN 'ambiguous' WHEN first_up < first_down THEN 'upper' ELSE 'lower' END AS barrier
FROM (
  SELECT b.instrument_id, b.ts, max(f.ts) FILTER (f.idx = b.idx + {HORIZON}) AS label_end,
    max(f.close) FILTER (f.idx = b.idx + {HORIZON}) / b.close - 1 AS future_return,
    coalesce(min(f.idx - b.idx) FILTER (f.high >= b.close * (1.0::DOUBLE + {UPPER})), 99) AS first_up,
    coalesce(min(f.idx - b.idx) FILTER (f.low <= b.close * (1.0::DOUBLE - {LOWER})), 99) AS first_down
  FROM numbered b JOIN numbered f ON f.instrument_id = b.instrument_id
    AND f.idx > b.idx AND f.idx <= b.idx + {HORIZON}
  GROUP BY b.instrument_id, b.ts, b.close, b.idx)
WHERE label_end IS NOT NULL""",
)


def _labels(spark, sf):
    bars = fx.research_daily(spark, sf)
    return labels.label_rows(bars, DAILY, HORIZON, THRESHOLD, UPPER, LOWER)


def _dataset(spark, sf):
    bars = fx.research_daily(spark, sf)
    return labels.build_dataset(bars, DAILY, HORIZON, THRESHOLD, UPPER, LOWER)


@query(
    "label_future_return",
    f"""SELECT instrument_id, {sql_stamp()} AS ts, {sql_stamp("label_end")} AS label_end,
    {sql_rounded(["future_return"])} FROM label_values""",
)
def label_future_return(spark, sf):
    return _labels(spark, sf).select(
        "instrument_id", stamp().alias("ts"), stamp("label_end").alias("label_end"),
        *rounded(["future_return"]),
    )


@query(
    "label_direction",
    f"SELECT instrument_id, {sql_stamp()} AS ts, direction, target FROM label_values",
)
def label_direction(spark, sf):
    return _labels(spark, sf).select("instrument_id", stamp().alias("ts"), "direction", "target")


@query("label_barrier", f"SELECT instrument_id, {sql_stamp()} AS ts, barrier FROM label_values")
def label_barrier(spark, sf):
    return _labels(spark, sf).select("instrument_id", stamp().alias("ts"), "barrier")


_SHOWN = ["return_5", "zscore_20", "volume_ratio_20", "sma_50"]


@query(
    "dataset_rows",
    f"""SELECT instrument_id, {sql_stamp("l.ts")} AS ts,
    {", ".join(sql_rounded([c], feature_digits(c)) for c in _SHOWN)}, direction, target, barrier
    FROM window_values w JOIN label_values l USING (instrument_id, ts)""",
)
def dataset_rows(spark, sf):
    digits = {c: feature_digits(c) for c in _SHOWN}
    return _dataset(spark, sf).select(
        "instrument_id", stamp().alias("ts"), *rounded(digits), "direction", "target", "barrier"
    )


@query(
    "scan_dataset",
    """SELECT instrument_id, count(*) AS n, sum(target) AS positives FROM label_values
    GROUP BY instrument_id""",
)
def scan_dataset(spark, sf):
    """A stored dataset read back through its lineage and duplicate checks."""
    path = scratch_path(spark, "dataset")
    sinks.write_once(_labels(spark, sf), path)
    rows = sinks.read_table(spark, path)
    checked = rules.mark_duplicates(rows, ["instrument_id", "ts"])
    clean = rules.flag(checked, {"duplicate_row": F.col("duplicate")} | rules.label_rules())
    return (
        rules.require_clean(clean)
        .groupBy("instrument_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"))
    )


@query(
    "feature_artifact_counts",
    """SELECT count(*) AS feature_rows,
    (SELECT count(*) FROM label_values) AS label_rows FROM bars_daily""",
)
def feature_artifact_counts(spark, sf):
    bars = fx.research_daily(spark, sf)
    features, labelled = scratch_path(spark, "features"), scratch_path(spark, "labels")
    sinks.write_once(build_features(bars, DAILY), features)
    sinks.write_once(labels.label_rows(bars, DAILY, HORIZON, THRESHOLD, UPPER, LOWER), labelled)

    def ones(path, f, n):
        return sinks.read_table(spark, path).select(F.lit(f).alias("f"), F.lit(n).alias("n"))

    return (
        ones(features, 1, 0)
        .unionByName(ones(labelled, 0, 1))
        .agg(F.sum("f").alias("feature_rows"), F.sum("n").alias("label_rows"))
    )


@query(
    "v_labels",
    f"""SELECT instrument_id, {sql_stamp()} AS ts FROM label_values
    WHERE barrier = 'neither' OR direction = 1 AND day(ts) = 13""",
)
def v_labels(spark, sf):
    rows = _labels(spark, sf)
    spoiled = rows.withColumns(
        {
            "label_end": F.when(F.col("barrier") == "neither", F.col("ts")).otherwise(
                F.col("label_end")
            ),
            "direction": F.when(F.dayofmonth("ts") == 13, F.col("direction") * 2).otherwise(
                F.col("direction")
            ),
        }
    )
    bad = rules.split(rules.flag(spoiled, rules.label_rules()))[1]
    return bad.select("instrument_id", stamp().alias("ts"))


@query("v_target_def", "SELECT count(DISTINCT CASE WHEN target = 1 THEN 6 ELSE 5 END) AS versions FROM label_values")
def v_target_def(spark, sf):
    rows = _labels(spark, sf)
    other = rows.withColumn("horizon", F.when(F.col("target") == 1, 6).otherwise(F.col("horizon")))
    definition = ["horizon", "threshold", "label_version", "upper_barrier", "lower_barrier"]
    return rules.mixed_values(other, [], definition)


@query(
    "v_features",
    f"""SELECT instrument_id, {sql_stamp()} AS ts FROM window_values
    WHERE coalesce(return_20 > 5, false) OR day(ts) = 17""",
)
def v_features(spark, sf):
    rows = build_features(fx.research_daily(spark, sf), DAILY)
    spoiled = rows.withColumns(
        {
            "return_20": F.when(F.col("return_20") > 5, F.lit(float("inf"))).otherwise(
                F.col("return_20")
            ),
            "feature_version": F.when(F.dayofmonth("ts") == 17, "older").otherwise(
                F.col("feature_version")
            ),
        }
    )
    used = ["return_1", "return_20"]
    rules.require_columns(spoiled, used)
    bad = rules.split(rules.flag(spoiled, rules.feature_rules(used, "research-v1")))[1]
    return bad.select("instrument_id", stamp().alias("ts"))


# --- folds -------------------------------------------------------------------------------

EXPANDING = splits.Folds(600, 150, 200)
ROLLING = splits.Folds(400, 100, 150, step=120, expanding=False)


def _fold_sql(f: splits.Folds) -> str:
    start = "0" if f.expanding else f"g.fold_end - {f.train}"
    return f"""times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM label_values)),
  ends AS (SELECT unnest(range({f.train}, (SELECT count(*) FROM times) - {f.validation} - {f.test} + 1, {f.stride})) AS fold_end),
  edges AS (SELECT (g.fold_end - {f.train}) // {f.stride} AS fold, a.ts AS train_start, b.ts AS validation_start,
      c.ts AS test_start, d.ts AS test_end
    FROM ends g JOIN times a ON a.t = {start} JOIN times b ON b.t = g.fold_end
    JOIN times c ON c.t = g.fold_end + {f.validation} JOIN times d ON d.t = g.fold_end + {f.validation + f.test - 1}),
  placed AS (
    SELECT fold, 'train' AS part, l.* FROM edges JOIN label_values l ON l.ts >= train_start AND l.ts < validation_start
      AND label_end < validation_start
    UNION ALL SELECT fold, 'validation', l.* FROM edges JOIN label_values l ON l.ts >= validation_start
      AND l.ts < test_start AND label_end < test_start
    UNION ALL SELECT fold, 'test', l.* FROM edges JOIN label_values l ON l.ts BETWEEN test_start AND test_end)"""


def _walk(name: str, folds: splits.Folds) -> None:
    @query(
        name,
        f"""WITH {_fold_sql(folds)} SELECT fold, part, instrument_id, count(*) AS n,
        {sql_stamp("min(ts)")} AS first_ts, {sql_stamp("max(ts)")} AS last_ts,
        {sql_stamp("max(label_end)")} AS label_end FROM placed GROUP BY ALL""",
    )
    def run(spark, sf):
        found = splits.fold_ranges(staged(_labels(spark, sf), "labels"), DAILY, folds, ["instrument_id"])
        return found.select(
            "fold", "part", "instrument_id", F.col("rows").alias("n"), stamp("start").alias("first_ts"),
            stamp("end").alias("last_ts"), stamp("label_end").alias("label_end"),
        )


_walk("walk_forward", EXPANDING)
_walk("walk_forward_rolling", ROLLING)


@query(
    "split_ranges",
    f"""WITH {_fold_sql(EXPANDING)} SELECT fold, part, {sql_stamp("min(ts)")} AS start_ts,
    {sql_stamp("max(ts)")} AS end_ts, {sql_stamp("max(label_end)")} AS label_end, count(*) AS n
    FROM placed GROUP BY ALL""",
)
def split_ranges(spark, sf):
    found = splits.fold_ranges(staged(_labels(spark, sf), "labels"), DAILY, EXPANDING)
    return found.select(
        "fold", "part", stamp("start").alias("start_ts"), stamp("end").alias("end_ts"),
        stamp("label_end").alias("label_end"), F.col("rows").alias("n"),
    )


# A fault for the guards: no positive label before 1994.
_SOWN = """sown AS (SELECT * REPLACE (CASE WHEN year(ts) < 1994 THEN 0 ELSE target END AS target) FROM label_values)"""


@query(
    "split_guards",
    f"""WITH {_SOWN}, {_fold_sql(ROLLING).replace("label_values", "sown")},
    wide AS (SELECT fold, count(*) FILTER (part = 'train') AS train_rows,
      CAST(sum(target) FILTER (part = 'train') AS BIGINT) AS train_positives FROM placed GROUP BY fold)
    SELECT *, CASE WHEN train_positives IN (0, train_rows) THEN 'one_class' ELSE '' END AS reasons FROM wide""",
)
def split_guards(spark, sf):
    rows = _labels(spark, sf)
    none = F.when(F.year("ts") < 1994, F.lit(0)).otherwise(F.col("target"))
    sown = staged(rows.withColumn("target", none.cast(rows.schema["target"].dataType)), "labels")
    guards = splits.fold_guards(splits.fold_ranges(sown, DAILY, ROLLING))
    return guards.select(
        "fold", "train_rows", "train_positives", F.array_join("reasons", ",").alias("reasons")
    )


# --- models ------------------------------------------------------------------------------

_MODEL_FEATURES = [
    "return_1", "return_5", "zscore_20", "bollinger_position", "volume_ratio_20", "oi_change",
    "realized_volatility_20", "basis",
]
# Everything before this instant is the train part of the preprocessing queries.
_CUT = "1998-01-01"
_TRAIN_SQL = f"(SELECT * FROM window_values WHERE ts < TIMESTAMP '{_CUT}')"


def _train(spark, sf):
    rows = build_features(fx.research_daily(spark, sf), DAILY)
    kept = rows.select("instrument_id", "ts", *_MODEL_FEATURES)
    return staged(kept.filter(F.col("ts") < F.lit(_CUT).cast("timestamp")), "train")


@query(
    "ml_feature_select",
    "SELECT feature, observed FROM (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in _MODEL_FEATURES)
    + f" FROM {_TRAIN_SQL}) UNPIVOT (observed FOR feature IN ({', '.join(_MODEL_FEATURES)}))",
)
def ml_feature_select(spark, sf):
    return models.observed_counts(_train(spark, sf), _MODEL_FEATURES).filter("observed > 0")


@query(
    "ml_impute",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(median({c}), 6) + 0.0::DOUBLE AS median FROM {_TRAIN_SQL}"
        for c in _MODEL_FEATURES
    ),
)
def ml_impute(spark, sf):
    fitted = models.medians(_train(spark, sf), _MODEL_FEATURES)
    return fitted.select("feature", *rounded(["median"], 6))


@query(
    "ml_scale",
    f"""WITH filled AS (SELECT coalesce(return_5, (SELECT median(return_5) FROM {_TRAIN_SQL})) AS a,
      coalesce(oi_change, (SELECT median(oi_change) FROM {_TRAIN_SQL})) AS b, instrument_id, ts FROM {_TRAIN_SQL})
    SELECT instrument_id, {sql_stamp()} AS ts,
      round((a - (SELECT avg(a) FROM filled)) / (SELECT stddev_pop(a) FROM filled), 6) + 0.0::DOUBLE AS return_5,
      round((b - (SELECT avg(b) FROM filled)) / (SELECT stddev_pop(b) FROM filled), 6) + 0.0::DOUBLE AS oi_change
    FROM filled""",
)
def ml_scale(spark, sf):
    used = ["return_5", "oi_change"]
    train = _train(spark, sf)
    fill = {r["feature"]: r["median"] for r in models.medians(train, used).collect()}
    fitted = models.fitted_scaling(train, fill)
    return train.select(
        "instrument_id",
        stamp().alias("ts"),
        *[
            (F.round(models.scaled(f, fill[f], *fitted[f]), 6) + F.lit(0.0)).alias(f)
            for f in used
        ],
    )


@query(
    "ml_target_barrier",
    """SELECT count(*) FILTER (barrier IN ('upper', 'lower')) AS retained,
    count(*) FILTER (barrier NOT IN ('upper', 'lower')) AS excluded_barrier_rows FROM label_values""",
)
def ml_target_barrier(spark, sf):
    return models.excluded_barriers(_labels(spark, sf))


def _fit_and_score(spark, sf, kind: str, field: str = "target"):
    rows = _dataset(spark, sf)
    path = scratch_path(spark, "dataset")
    sinks.write_once(rows, path)  # fits read the data many times
    rows = sinks.read_table(spark, path)
    bounds = splits.fold_bounds(splits.time_index(rows, DAILY), EXPANDING)
    train = splits.one_part(rows, bounds, 0, "train", EXPANDING)
    test = splits.one_part(rows, bounds, 0, "test", EXPANDING)
    model = models.train_model(train, kind, target_field=field)
    scored = model.predict(models.with_target(test, field))
    return model, scored.withColumn("y", F.col("label"))


@query("ml_logistic")
def ml_logistic(spark, sf):
    model, scored = _fit_and_score(spark, sf, "logistic")
    path = scratch_path(spark, "model")
    models.save_model(model, path, spark)
    again = models.load_model(path, spark)
    return ev.confusion(again.predict(scored.drop("p")), ["instrument_id"])


@query("ml_forest")
def ml_forest(spark, sf):
    _, scored = _fit_and_score(spark, sf, "random_forest", "barrier")
    return ev.confusion(scored, ["instrument_id"])


@query("ml_train_folds")
def ml_train_folds(spark, sf):
    """One logistic model per rolling fold: each fold is its own distributed fit."""
    path = scratch_path(spark, "dataset")
    sinks.write_once(_dataset(spark, sf), path)
    rows = sinks.read_table(spark, path)
    bounds = splits.fold_bounds(splits.time_index(rows, DAILY), ROLLING)
    out = None
    for fold in [r["fold"] for r in bounds.select("fold").orderBy("fold").collect()]:
        train = splits.one_part(rows, bounds, fold, "train", ROLLING)
        test = splits.one_part(rows, bounds, fold, "test", ROLLING)
        model = models.train_model(train, features=_MODEL_FEATURES)
        scored = model.predict(models.with_target(test, "target")).withColumn("y", F.col("label"))
        one = ev.confusion(scored).withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out


# --- evaluation --------------------------------------------------------------------------


@query(
    "eval_confusion",
    """SELECT lang, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
    FROM (SELECT lang, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
      count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp
      FROM predictions GROUP BY lang)""",
)
def eval_confusion(spark, sf):
    rows = ev.confusion(fx.predictions(spark, sf), ["lang"])
    return rows.select("lang", "tn", "fp", "fn", "tp", *rounded(["precision", "recall", "f1"], 6))


@query(
    "eval_roc_auc",
    """SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)::DOUBLE
      / count(*), 8) AS roc_auc
    FROM (SELECT p FROM predictions WHERE y = 1) a, (SELECT p FROM predictions WHERE y = 0) b""",
)
def eval_roc_auc(spark, sf):
    return ev.ranking(fx.predictions(spark, sf)).select(*rounded(["roc_auc"], 8))


@query(
    "eval_pr_auc",
    """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 8) AS pr_auc FROM (
      SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
        SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM predictions GROUP BY p)
      WINDOW w AS (ORDER BY p DESC))""",
)
def eval_pr_auc(spark, sf):
    return ev.ranking(fx.predictions(spark, sf)).select(*rounded(["pr_auc"], 8))


@query("eval_brier", "SELECT round(avg(power(p - y, 2)), 8) AS brier FROM predictions")
def eval_brier(spark, sf):
    return ev.brier(fx.predictions(spark, sf)).select(*rounded(["brier"], 8))


@query(
    "eval_calibration",
    """SELECT low AS lower, count(*) AS count, round(avg(p), 8) AS predicted, round(avg(y), 8) AS observed
    FROM predictions, (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS low)
    WHERE p >= low AND CASE WHEN low < 0.8 THEN p < low + 0.2::DOUBLE ELSE p <= 1 END GROUP BY low""",
)
def eval_calibration(spark, sf):
    rows = ev.calibration(fx.predictions(spark, sf))
    return rows.select("lower", "count", *rounded(["predicted", "observed"], 8))


@query(
    "eval_consequence",
    """SELECT round(avg(CASE WHEN p >= 0.5 THEN move / 1000 - 0.0025::DOUBLE ELSE 0 END), 8)
      AS mean_signal_future_return_after_cost FROM predictions""",
)
def eval_consequence(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("future_return", F.col("move") / 1000)
    column = "mean_signal_future_return_after_cost"
    return ev.consequence(rows, 25.0).select(*rounded([column], 8))


@query(
    "eval_partition",
    f"""WITH {_fold_sql(EXPANDING)}
    SELECT 'test' AS partition, instrument_id, count(*) AS n FROM label_values
      WHERE ts BETWEEN (SELECT min(ts) FROM placed WHERE fold = 0 AND part = 'test')
        AND (SELECT max(ts) FROM placed WHERE fold = 0 AND part = 'test') GROUP BY instrument_id
    UNION ALL SELECT 'out_of_sample', instrument_id, count(*) FROM label_values
      WHERE ts > (SELECT max(label_end) FROM placed WHERE fold = 0 AND part = 'validation')
      GROUP BY instrument_id""",
)
def eval_partition(spark, sf):
    rows = staged(_labels(spark, sf), "labels")
    ranges = splits.fold_ranges(rows, DAILY, EXPANDING)
    out = None
    for partition in ("test", "out_of_sample"):
        chosen = ev.evaluation_rows(rows, ranges, 0, partition)
        counted = chosen.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.withColumn("partition", F.lit(partition))
        out = counted if out is None else out.unionByName(counted)
    return out


