"""Walk-forward folds over distinct times, with purging of labels that reach a boundary.

With times numbered, a row belongs to one run of folds as train, one as validation and one as test row, given
by arithmetic. So folds stay predicates: ``fold_ranges`` adds up the rows of equal runs first and gives each
fold its share afterwards, and ``one_part`` filters by time. Only ``assign_parts`` writes a row once per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.cells import failed
from tapeworks.functions.series import Grid, running
from tapeworks.session import staged


@dataclass(frozen=True)
class Folds:
    train: int
    validation: int
    test: int
    step: int | None = None
    expanding: bool = True

    def __post_init__(self) -> None:
        for n in (self.train, self.validation, self.test, self.stride):
            if isinstance(n, bool) or n < 1:
                raise ValueError("split sizes must be positive")

    @property
    def stride(self) -> int:
        return self.test if self.step is None else self.step


def time_index(rows: DataFrame, grid: Grid) -> DataFrame:
    """Distinct times with their rank, numbered bucket by bucket instead of in one task."""
    times = rows.select("ts").distinct()
    ranked = running(times, [], ["ts"], grid.bucket("ts"), {"_rank": ("count", F.lit(1))})
    return ranked.select("ts", (F.col("_rank") - 1).alias("t"))


def fold_bounds(times: DataFrame, folds: Folds) -> DataFrame:
    """One row per complete fold: where its parts start and where its test part ends."""
    first_test = folds.train + folds.validation
    edges = {
        "rolling_start": 0,
        "validation_start": folds.train,
        "test_start": first_test,
        "test_end": first_test + folds.test - 1,
    }
    marks = F.array(
        *[F.struct(F.lit(n).alias("edge"), (F.col("t") - o).alias("at")) for n, o in edges.items()]
    )
    hits = F.filter(marks, lambda m: (m["at"] >= 0) & (m["at"] % folds.stride == 0))
    placed = times.select("ts", F.explode(hits).alias("m")).withColumn(
        "fold", (F.col("m.at") / folds.stride).cast("bigint")
    )
    wide = placed.groupBy("fold").agg(
        *[F.max(F.when(F.col("m.edge") == n, F.col("ts"))).alias(n) for n in edges]
    )
    return wide.filter(F.col("test_end").isNotNull())


def instants(rows: DataFrame, grid: Grid) -> DataFrame:
    """``at`` and ``t``, the number of distinct times up to it less one, for every ts and label_end."""
    marks = rows.select(F.col("ts").alias("at"), F.lit(1).alias("is_time")).distinct()
    marks = marks.unionByName(
        rows.filter("label_end IS NOT NULL").select(F.col("label_end").alias("at"), F.lit(0).alias("is_time")).distinct()
    )
    marks = marks.groupBy("at").agg(F.max("is_time").alias("is_time"))
    ranked = running(marks, [], ["at"], grid.bucket("at"), {"_rank": ("sum", F.col("is_time"))})
    return ranked.select("at", (F.col("_rank") - 1).alias("t"))


def fold_runs(rows: DataFrame, grid: Grid, folds: Folds) -> DataFrame:
    """``rows`` with ``runs``: array of (part, low, high), the folds that hold the row in each part.

    Purging is in the runs: a train row's label ends before the validation part of all its folds, a
    validation row's before their test part. Rows of no fold have an empty array.
    """
    index = staged(instants(rows, grid), "instants")
    first_test = folds.train + folds.validation
    newest = F.floor((index.agg(F.max("t")).scalar() - (first_test + folds.test - 1)) / F.lit(folds.stride))
    joined = rows.join(index.select(F.col("at").alias("ts"), "t"), "ts").join(
        index.select(F.col("at").alias("label_end"), F.col("t").alias("_u")), "label_end", "left"
    )
    joined = joined.withColumn("_last", newest)
    t, step, last = F.col("t"), F.lit(folds.stride), F.col("_last")
    # A row without the end of its label is in no train or validation part.
    reach = F.when(F.col("_u").isNotNull(), F.greatest(t, F.col("_u")))

    def after(x: Column, offset: int) -> Column:
        """The first fold whose part at ``offset`` starts after the time numbered ``x``."""
        return F.floor((x - offset) / step) + 1

    def run(part: str, low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.lit(0)).cast("long"), F.least(high, last).cast("long")
        return F.struct(F.lit(part).alias("part"), low.alias("low"), high.alias("high"))

    parts = F.array(
        run("train", F.coalesce(after(reach, folds.train), last + 1), last if folds.expanding else F.floor(t / step)),
        run("validation", F.coalesce(after(reach, first_test), last + 1), after(t, folds.train) - 1),
        run("test", after(t, first_test + folds.test), after(t, first_test) - 1),
    )
    runs = F.filter(parts, lambda x: x["low"] <= x["high"])
    return joined.select(*rows.columns, runs.alias("runs"))


def _whole_folds(parts: DataFrame) -> DataFrame:
    """Folds of which every part has rows."""
    seen = parts.select("fold", "part").distinct().groupBy("fold").agg(F.count("*").alias("parts"))
    return seen.filter("parts = 3").select("fold")


def assign_parts(rows: DataFrame, grid: Grid, folds: Folds) -> DataFrame:
    """Rows with ``fold`` and ``part`` after purging, once per fold; incomplete folds are dropped.

    For a fit of a few folds only; sizes and ranges come from ``fold_ranges``.
    """
    placed = fold_runs(rows, grid, folds).select(*rows.columns, F.inline("runs"))
    placed = placed.select(*rows.columns, F.explode(F.sequence("low", "high")).alias("fold"), "part")
    return placed.join(_whole_folds(placed), "fold", "left_semi").select(*rows.columns, "fold", "part")


def fold_ranges(rows: DataFrame, grid: Grid, folds: Folds, keys: Sequence[str] = ()) -> DataFrame:
    """fold, part (and ``keys``): start, end, label_end, rows and positives; incomplete folds are dropped.

    Rows are added up by the run of folds they belong to before anything moves. A run of an expanding train
    part never ends, so its totals run on from fold to fold; other runs are as long as parts overlap.
    """
    runs = fold_runs(rows, grid, folds).select("ts", "label_end", "target", *keys, F.inline("runs"))
    cells = runs.groupBy("part", "low", "high", *keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("label_end").alias("label_end"),
        F.count("*").alias("rows"), F.sum("target").alias("positives"),
    )
    folded = {"start": F.min, "end": F.max, "label_end": F.max, "rows": F.sum, "positives": F.sum}
    if folds.expanding:
        along = Window.partitionBy("part", *keys).orderBy("low")
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        train = F.col("part") == "train"
        grown = {n: F.when(train, f(n).over(upto)).otherwise(F.col(n)) for n, f in folded.items()}
        until = F.when(train, F.coalesce(F.lead("low").over(along) - 1, F.col("high"))).otherwise(F.col("high"))
        cells = cells.select("part", "low", until.alias("high"), *keys, *[v.alias(n) for n, v in grown.items()])
    each = cells.withColumn("fold", F.explode(F.sequence("low", "high")))
    found = staged(each.groupBy("fold", "part", *keys).agg(*[f(n).alias(n) for n, f in folded.items()]), "ranges")
    return found.join(_whole_folds(found), "fold", "left_semi")


def one_part(rows: DataFrame, bounds: DataFrame, fold: int, part: str, folds: Folds) -> DataFrame:
    """Rows of one part by time filters only; nothing is multiplied by the number of folds."""
    edge = bounds.filter(F.col("fold") == fold).first()
    if edge is None:
        raise ValueError(f"no fold {fold}")
    ts, end = F.col("ts"), F.col("label_end")
    start, test = F.lit(edge["validation_start"]), F.lit(edge["test_start"])
    if part == "train":
        keep = (ts < start) & (end < start)
        if not folds.expanding:
            keep = keep & (ts >= F.lit(edge["rolling_start"]))
    elif part == "validation":
        keep = (ts >= start) & (ts < test) & (end < test)
    else:
        keep = (ts >= test) & (ts <= F.lit(edge["test_end"]))
    return rows.filter(keep)


def part_ranges(placed: DataFrame) -> DataFrame:
    return placed.groupBy("fold", "part").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.max("label_end").alias("label_end"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("target").alias("positives"),
    )


def split_guards(placed: DataFrame) -> DataFrame:
    return fold_guards(part_ranges(placed))


def fold_guards(r: DataFrame) -> DataFrame:
    """Per fold of ``r`` (part ranges): what would make a fit invalid. Clean folds have no reasons."""
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = r.groupBy("fold").agg(
        *[
            pick(part, c).alias(f"{part}_{c}")
            for part in ("train", "validation", "test")
            for c in ("start", "label_end", "rows", "positives")
        ]
    )
    c = F.col
    checks = {
        "empty_part": c("train_rows").isNull() | c("validation_rows").isNull()
        | c("test_rows").isNull(),
        "overlapping_labels": (c("train_label_end") >= c("validation_start"))
        | (c("validation_label_end") >= c("test_start")),
        "one_class": (c("train_positives") == 0) | (c("train_positives") == c("train_rows")),
    }
    return wide.withColumn("reasons", failed(checks))
