"""Ordered work on keyed series without sending a whole key to one task.

A key (an instrument, an account) may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would run that share in one task. Both helpers here cut every
series along its order column into time buckets first:

* ``split_series`` groups buckets into blocks of about ``block_rows`` rows and copies the
  rows a bounded frame needs from the neighbouring blocks, so row frames stay exact inside
  ``(key, block)``.
* ``running`` does prefix aggregates in two levels: inside a bucket, plus a carry over the
  per-bucket totals.

The bucket tables hold one row per (key, bucket). They are joined without a hint: adaptive
execution broadcasts them when their measured size allows and shuffles otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, OWN, BASE, BUCKET = "_block", "_own", "_base", "_bucket"


@dataclass(frozen=True)
class Grid:
    """Sizes of the pieces. Rows of one key are at least ``bar_seconds`` apart, so a time
    bucket holds at most ``bucket_rows`` of them."""

    bar_seconds: int = 60
    bucket_rows: int = 1024
    block_rows: int = 131072

    def bucket(self, ts: str | Column) -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        return F.floor(F.unix_seconds(ts) / F.lit(self.bar_seconds * self.bucket_rows))


DAILY = Grid(bar_seconds=86400)
HOURLY = Grid(bar_seconds=3600)
MINUTE = Grid(bar_seconds=60)


def split_series(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    *,
    before: int = 0,
    after: int = 0,
    block_rows: int = Grid.block_rows,
) -> DataFrame:
    """Tag rows with ``_block``; copy ``before``/``after`` neighbour rows with ``_own`` false.

    ``_base`` is the position in the whole series of the first row present in the block, so
    ``_base + row_number() - 1`` is the exact position of any row.
    """
    keys = list(keys)
    tagged = df.withColumn(BUCKET, bucket)
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    runs = (
        tagged.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(by_bucket))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_blk", F.floor(F.col("_start") / F.lit(block_rows)))
        .withColumn("_next", F.lead("_blk").over(by_bucket))
        .withColumn("_prev", F.lag("_blk").over(by_bucket))
    )
    own = F.array(F.struct(F.col("_blk").alias("b"), F.lit(True).alias("own")))
    targets = [own]

    def copies(neighbour: str, frame) -> Column:
        starts = F.collect_list(F.when(F.col(neighbour) != F.col("_blk"), F.col(neighbour)))
        return F.transform(
            starts.over(frame), lambda b: F.struct(b.alias("b"), F.lit(False).alias("own"))
        )

    if before:
        # A block starting at row s needs every bucket that ends after s - before.
        frame = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, before - 1)
        runs = runs.withColumn("_fwd", copies("_next", frame))
        targets.append(F.col("_fwd"))
    if after:
        # A block ending at row e needs every bucket that starts before e + after.
        frame = Window.partitionBy(*keys).orderBy("_start").rangeBetween(1 - after, 0)
        runs = runs.withColumn("_bwd", copies("_prev", frame))
        targets.append(F.col("_bwd"))
    plan = (
        runs.select(*keys, BUCKET, "_start", F.explode(F.concat(*targets)).alias("_t"))
        .select(*keys, BUCKET, "_start", F.col("_t.b").alias(BLOCK), F.col("_t.own").alias(OWN))
        .withColumn(BASE, F.min("_start").over(Window.partitionBy(*keys, BLOCK)))
        .drop("_start")
    )
    return tagged.join(plan, [*keys, BUCKET]).drop(BUCKET)


def block_window(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def positions(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Exact zero-based position of each row in its whole series."""
    number = F.row_number().over(block_window(keys, order))
    return df.withColumn("_idx", F.col(BASE) + number - F.lit(1))


def owned(df: DataFrame) -> DataFrame:
    """Drop the copied rows and every helper column."""
    return df.filter(OWN).drop(*[c for c in df.columns if c.startswith("_")])


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    measures: dict[str, tuple[str, Column]],
    *,
    include_current: bool = True,
) -> DataFrame:
    """Prefix aggregates over each key in ``order``; ``bucket`` must not decrease along it.

    Kinds: ``sum``, ``count``, ``max``, ``min``; ``last`` is the latest non-null value so far
    and ``next`` the earliest non-null value strictly after the row.
    """
    keys, order = list(keys), list(order)
    key_names = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    tagged = df.withColumn(BUCKET, bucket)
    for name, (kind, value) in measures.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    aggs, carries = [], {}
    earlier = Window.partitionBy(*key_names).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    later = Window.partitionBy(*key_names).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    for name, (kind, _) in measures.items():
        value, total, carry = F.col(f"_v_{name}"), f"_t_{name}", f"_c_{name}"
        if kind in _FOLD:
            aggs.append(_FOLD[kind](value).alias(total))
            fold = F.sum if kind == "count" else _FOLD[kind]
            carries[carry] = fold(total).over(earlier)
        else:
            ranked = F.when(value.isNotNull(), F.struct(*order, value.alias("v")))
            pick = F.max if kind == "last" else F.min
            aggs.append(pick(ranked).alias(total))
            edge = (
                F.last(total, ignorenulls=True).over(earlier)
                if kind == "last"
                else F.first(total, ignorenulls=True).over(later)
            )
            carries[carry] = edge["v"]
    carry_table = (
        tagged.groupBy(*key_names, BUCKET)
        .agg(*aggs)
        .withColumns(carries)
        .drop(*[f"_t_{n}" for n in measures])
    )
    joined = tagged.join(carry_table, [*key_names, BUCKET], "left")
    inside = Window.partitionBy(*key_names, BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    out = {}
    for name, (kind, _) in measures.items():
        value, carry = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            local = _FOLD[kind](value).over(upto)
            both = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
            out[name] = F.when(local.isNotNull() | carry.isNotNull(), both)
        elif kind == "max":
            out[name] = F.greatest(F.max(value).over(upto), carry)
        elif kind == "min":
            out[name] = F.least(F.min(value).over(upto), carry)
        elif kind == "last":
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(upto), carry)
        else:
            out[name] = F.coalesce(F.first(value, ignorenulls=True).over(after), carry)
    helpers = [BUCKET, "_all", *[f"_v_{n}" for n in measures], *[f"_c_{n}" for n in measures]]
    return joined.withColumns(out).drop(*helpers)


def salted_lookup(
    big: DataFrame, small: DataFrame, keys: Sequence[str], *, salts: int = 16, how: str = "left"
) -> DataFrame:
    """Join a table whose keys may be hot to one row per key, spread over ``salts`` tasks."""
    keys = list(keys)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in keys]), F.lit(salts))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumn("_salt", F.col("_salt").cast("bigint"))
    left = big.withColumn("_salt", spread.cast("bigint"))
    return left.join(copies, [*keys, "_salt"], how).drop("_salt")


#: A weight of ``exp(-FADED)`` (1e-40) changes no double; ``exp(SPREAD)`` (1e100) overflows none.
FADED, SPREAD = 92.0, 230.0


def memory_rows(decay: float) -> int:
    """Rows after which y[i] = d * y[i-1] + u[i] has forgotten where it started."""
    return 1 if decay <= 0 else 1 + math.ceil(FADED / -math.log(decay))


def _run_rows(decays: Sequence[float]) -> int | None:
    """Rows of a run long enough to forget what was before the previous run, and short enough for
    every power in it; none if the decays are too far apart for one length."""
    least = max(memory_rows(d) for d in decays)
    most = min(math.floor(SPREAD / -math.log(d)) for d in decays)
    return most if least <= most else None


def affine_scan(
    df: DataFrame, keys: Sequence[str], order: str, terms: dict[str, tuple[Column, float]]
) -> DataFrame:
    """y[i] = d * y[i-1] + u[i] for several (u, d), with 0 <= d < 1, in each block.

    Needs ``_idx``. The sum is taken relative to the start of a run of rows, whose length follows from
    d: powers stay in range, and what stood before the previous run weighs less than 1e-40. A block
    must begin with ``memory_rows(d)`` copied rows for its own ones to be exact. Terms whose decays
    suit the same length share their windows.
    """
    df = df.withColumns({name: u for name, (u, d) in terms.items() if d <= 0})
    moving = {name: x for name, x in terms.items() if x[1] > 0}
    if not moving:
        return df
    rows = _run_rows([d for _, d in moving.values()])
    if rows is None:
        for name, x in moving.items():
            df = affine_scan(df, keys, order, {name: x})
        return df
    run, k = F.floor(F.col("_idx") / F.lit(rows)), F.col("_idx") % F.lit(rows)
    local = (
        Window.partitionBy(*keys, BLOCK, run).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = block_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            f"_{name}_loc": F.pow(F.lit(d), k) * F.sum(u * F.pow(F.lit(d), -k)).over(local)
            for name, (u, d) in moving.items()
        }
    )
    df = df.withColumns(
        {
            f"_{name}_end": F.last(
                F.when(k == rows - 1, F.col(f"_{name}_loc")), ignorenulls=True
            ).over(whole)
            for name in moving
        }
    )
    return df.withColumns(
        {
            name: F.col(f"_{name}_loc")
            + F.coalesce(F.col(f"_{name}_end"), F.lit(0.0)) * F.pow(F.lit(d), k + 1)
            for name, (_, d) in moving.items()
        }
    )


def last_of_earlier_blocks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` of any block before the row's own, one row a block moving."""
    known = F.when(F.col(value).isNotNull(), F.struct("_idx", F.col(value).alias("v")))
    ends = df.filter(OWN).groupBy(*keys, BLOCK).agg(F.max(known).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, BLOCK, F.last("_end", ignorenulls=True).over(earlier)["v"].alias(name))
    return df.join(ends, [*keys, BLOCK], "left")
