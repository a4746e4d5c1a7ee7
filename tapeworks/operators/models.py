"""Classifier fits on ``pyspark.ml``; imputation and scaling are fitted on the train part."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import FEATURES


def target_column(field: str) -> Column:
    if field not in ("target", "direction", "barrier"):
        raise ValueError("target_field must be target, direction or barrier")
    if field == "barrier":
        return (F.col("barrier") == "upper").cast("int")
    return F.col(field)


def with_target(rows: DataFrame, field: str) -> DataFrame:
    """Adds ``label``; rows whose barrier is not a clear touch are left out."""
    kept = rows.filter(F.col("barrier").isin("upper", "lower")) if field == "barrier" else rows
    return kept.withColumn("label", target_column(field))


def excluded_barriers(rows: DataFrame) -> DataFrame:
    clear = F.col("barrier").isin("upper", "lower")
    return rows.agg(
        F.count_if(clear).alias("retained"), F.count_if(~clear).alias("excluded_barrier_rows")
    )


def long_features(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    )
    return rows.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")


def observed_counts(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, observed): non-null training values, from one wide aggregate."""
    counts = train.agg(*[F.count(f).alias(f) for f in features])
    return counts.unpivot([], list(features), "feature", "observed")


def medians(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact medians without gathering a column: a quantile sketch brackets each median, the
    bracket is cut into cells, and only the cell holding the middle ranks is sorted."""
    cells = 4096
    values = long_features(train, features).filter(F.col("value").isNotNull())
    bracket = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", [0.49, 0.51], 10000).alias("q"),
    )
    bracket = bracket.select("feature", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    c = F.col
    cell = (
        F.when(c("value") < c("lo"), F.lit(-1))
        .when(c("value") > c("hi"), F.lit(cells + 1))
        .otherwise(
            F.floor(F.coalesce(F.try_divide(c("value") - c("lo"), c("hi") - c("lo")), F.lit(0.0)) * cells)
        )
        .cast("bigint")
    )
    # One bracket row per feature: a fixed, small side.
    placed = values.join(F.broadcast(bracket), "feature").withColumn("cell", cell)
    counted = placed.groupBy("feature", "cell", "n").agg(F.count(F.lit(1)).alias("m"))
    by_cell = Window.partitionBy("feature").orderBy("cell")
    counted = counted.withColumn("through", F.sum("m").over(by_cell)).withColumn(
        "below", c("through") - c("m")
    )
    first, second = F.floor((c("n") - 1) / 2), F.floor(c("n") / 2)
    middle = counted.filter(
        ((first >= c("below")) & (first < c("through")))
        | ((second >= c("below")) & (second < c("through")))
    ).select("feature", "cell", "below")
    inside = placed.join(F.broadcast(middle), ["feature", "cell"])
    distinct = inside.groupBy("feature", "cell", "value", "n", "below").agg(
        F.count(F.lit(1)).alias("m")
    )
    in_cell = Window.partitionBy("feature", "cell").orderBy("value")
    ranked = distinct.withColumn("upto", c("below") + F.sum("m").over(in_cell)).withColumn(
        "start", c("upto") - c("m")
    )
    hits = F.when((first >= c("start")) & (first < c("upto")), 1).otherwise(0) + F.when(
        (second >= c("start")) & (second < c("upto")), 1
    ).otherwise(0)
    return (
        ranked.withColumn("w", hits)
        .filter("w > 0")
        .groupBy("feature")
        .agg((F.sum(c("value") * c("w")) / F.lit(2.0)).alias("median"))
    )


def fitted_scaling(train: DataFrame, fill: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation after imputation; a zero deviation scales by one."""
    filled = {f: F.coalesce(F.col(f), F.lit(v)) for f, v in fill.items()}
    row = train.agg(
        *[F.avg(v).alias(f"m_{f}") for f, v in filled.items()],
        *[F.stddev_pop(v).alias(f"s_{f}") for f, v in filled.items()],
    ).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"] or 1.0) for f in fill}


def scaled(feature: str, fill: float, mean: float, deviation: float) -> Column:
    return (F.coalesce(F.col(feature), F.lit(fill)) - F.lit(mean)) / F.lit(deviation)


@dataclass
class Model:
    stages: PipelineModel
    features: list[str]
    metadata: dict

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``p``, the probability of the positive class."""
        scored = self.stages.transform(rows)
        return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def preprocessing(train: DataFrame, features: Sequence[str]) -> tuple[list[str], Transformer]:
    """Columns seen in training, and a SQL stage that imputes and standardises them."""
    seen = {r["feature"] for r in observed_counts(train, features).collect() if r["observed"]}
    used = sorted(seen)
    if not used:
        raise ValueError("no observed training features")
    fill = {r["feature"]: r["median"] for r in medians(train, used).collect()}
    scaling = fitted_scaling(train, fill)
    parts = ", ".join(
        f"(coalesce({f}, {fill[f]!r}D) - {m!r}D) / {s!r}D AS _x_{f}"
        for f, (m, s) in ((f, scaling[f]) for f in used)
    )
    return used, SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__")


def train_model(
    train: DataFrame,
    kind: str = "logistic",
    seed: int = 42,
    target_field: str = "target",
    features: Sequence[str] = FEATURES,
    metadata: dict | None = None,
) -> Model:
    rows = with_target(train, target_field)
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(classes) != {0, 1}:
        raise ValueError("training requires both binary classes")
    used, scale = preprocessing(rows, features)
    assemble = VectorAssembler(inputCols=[f"_x_{f}" for f in used], outputCol="features")
    if kind == "logistic":
        # Sum of losses with unit penalty equals mean loss with a penalty of 1/n.
        classifier = LogisticRegression(
            regParam=1.0 / sum(classes.values()), elasticNetParam=0.0, standardization=False,
            maxIter=2000, tol=1e-6,
        )
    elif kind == "random_forest":
        classifier = RandomForestClassifier(
            numTrees=100, maxDepth=6, minInstancesPerNode=2, seed=seed
        )
    else:
        raise ValueError("unknown model_kind")
    stages = Pipeline(stages=[scale, assemble, classifier]).fit(rows)
    facts = {
        "schema_version": 1,
        "model_id": str(uuid.uuid4()),
        "model_kind": kind,
        "seed": seed,
        "features": used,
        "target_field": target_field,
        "train_rows": sum(classes.values()),
    }
    return Model(stages, used, facts | (metadata or {}))


def save_model(model: Model, path: str, spark: SparkSession) -> None:
    """Write once: saving over an existing model fails."""
    model.stages.write().save(f"{path}/stages")
    row = [(json.dumps(model.metadata, sort_keys=True, default=str),)]
    spark.createDataFrame(row, "metadata string").coalesce(1).write.mode("errorifexists").text(
        f"{path}/metadata"
    )


def load_model(path: str, spark: SparkSession) -> Model:
    lines = spark.read.text(f"{path}/metadata").limit(2).collect()
    if len(lines) != 1:
        raise ValueError("model metadata is incomplete")
    metadata = json.loads(lines[0][0])
    return Model(PipelineModel.load(f"{path}/stages"), metadata["features"], metadata)
