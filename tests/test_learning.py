import random
from datetime import timedelta

import pytest
from market import BAR_SCHEMA, START, walk
from pyspark.sql import functions as F

from tapeworks.functions.series import Grid
from tapeworks.operators import evaluation as ev
from tapeworks.operators import models, splits
from tapeworks.operators.labels import build_dataset

GRID = Grid(bar_seconds=60, bucket_rows=8)


@pytest.fixture(scope="module")
def labels(spark):
    rows = []
    for name in "AB":
        for i in range(90):
            at = START + timedelta(minutes=i)
            if name == "A" or i % 3:
                rows.append((name, at, at + timedelta(minutes=4), i % 2))
    return rows, spark.createDataFrame(
        rows, "instrument_id string, ts timestamp, label_end timestamp, target int"
    )


@pytest.mark.parametrize("folds", [splits.Folds(30, 10, 10), splits.Folds(20, 8, 12, 7, False)])
def test_folds_match_a_plain_loop(labels, folds):
    rows, df = labels
    got = {
        (r.fold, r.part, r.instrument_id, r.ts.timestamp())
        for r in splits.assign_parts(df, GRID, folds).collect()
    }
    times = sorted({r[1] for r in rows})
    want = set()
    last = len(times) - folds.validation - folds.test
    for fold, end in enumerate(range(folds.train, last + 1, folds.stride)):
        begin = times[0] if folds.expanding else times[end - folds.train]
        val, test = times[end], times[end + folds.validation]
        stop = times[end + folds.validation + folds.test - 1]
        for name, ts, until, _ in rows:
            part = None
            if begin <= ts < val and until < val:
                part = "train"
            elif val <= ts < test and until < test:
                part = "validation"
            elif test <= ts <= stop:
                part = "test"
            if part:
                want.add((fold, part, name, ts.timestamp()))
    assert got == want


@pytest.mark.parametrize("folds", [splits.Folds(30, 10, 10), splits.Folds(20, 8, 12, 7, False), splits.Folds(9, 3, 3, 1)])
def test_ranges_are_those_of_the_rows(labels, folds):
    _, df = labels
    far = df.withColumn("label_end", F.when(F.minute("ts") == 40, F.col("ts") + F.expr("INTERVAL 20 MINUTES")).otherwise(F.col("label_end")))
    for keys in ([], ["instrument_id"]):
        placed = splits.assign_parts(far, GRID, folds)
        by = ["fold", "part", *keys]
        want = placed.groupBy(*by).agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("label_end").alias("label_end"),
            F.count("*").alias("rows"), F.sum("target").alias("positives"),
        )
        columns = [*by, "start", "end", "label_end", "rows", "positives"]
        got = splits.fold_ranges(far, GRID, folds, keys)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_fold_without_validation_rows_is_dropped(labels):
    _, df = labels
    # Labels reach four minutes ahead, so a two-minute validation part is purged away.
    assert splits.assign_parts(df, GRID, splits.Folds(30, 2, 10)).count() == 0
    with pytest.raises(ValueError):
        splits.Folds(0, 1, 1)


def test_exact_medians_on_skewed_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 0.0, 0.0, rng.random(), 1e9]), float(i), None) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["feature"]: r["median"] for r in models.medians(df, ["a", "b", "c"]).collect()}
    assert got["a"] == sorted(r[0] for r in rows)[499] and got["b"] == 499.0 and "c" not in got
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "a double")
    assert models.medians(even, ["a"]).first()["median"] == 3.0


def test_ranking_with_ties_and_one_class(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    got = ev.ranking(spark.createDataFrame(rows, "y int, p double")).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg))
    tp = fp = 0
    area = 0.0
    for score in sorted({p for _, p in rows}, reverse=True):
        hits = sum(y for y, p in rows if p == score)
        tp, fp = tp + hits, fp + sum(1 - y for y, p in rows if p == score)
        area += hits / len(pos) * tp / (tp + fp)
    assert got.pr_auc == pytest.approx(area)
    single = ev.ranking(spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")).first()
    assert single.roc_auc is None and single.pr_auc is None


def test_calibration_counts_an_exact_edge_twice(spark):
    df = spark.createDataFrame([(1, 0.6), (0, 0.1), (1, 1.0)], "y int, p double")
    got = {r["lower"]: r["count"] for r in ev.calibration(df).collect()}
    assert got == {0.0: 1, 0.4: 1, 0.6: 1, 0.8: 1}


def test_fit_save_and_load(spark, tmp_path):
    bars = spark.createDataFrame(walk(260, "A", 8) + walk(260, "B", 9), BAR_SCHEMA)
    rows = build_dataset(bars, GRID, horizon=2).cache()
    bounds = splits.fold_bounds(splits.time_index(rows, GRID), splits.Folds(200, 40, 40))
    folds = splits.Folds(200, 40, 40)
    train = splits.one_part(rows, bounds, 0, "train", folds)
    test = splits.one_part(rows, bounds, 0, "test", folds)
    # Features that are wild in the test part must not change the fit.
    model = models.train_model(train, features=["return_1", "zscore_20", "basis"])
    assert model.features == ["return_1", "zscore_20"]  # basis is never observed
    path = str(tmp_path / "model")
    models.save_model(model, path, spark)
    with pytest.raises(Exception, match="exists"):
        models.save_model(model, path, spark)
    again = models.load_model(path, spark)
    a = [r.p for r in model.predict(test).orderBy("ts", "instrument_id").collect()]
    b = [r.p for r in again.predict(test).orderBy("ts", "instrument_id").collect()]
    assert a == b and all(0 <= p <= 1 for p in a)
    with pytest.raises(ValueError, match="classes"):
        models.train_model(train.filter("target = 1"))
    forest = models.train_model(train, "random_forest", features=["return_1", "zscore_20"])
    assert forest.predict(test).filter(F.col("p").isNull()).count() == 0
