"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each partition belong in each shard follows a multivariate hypergeometric law, which
can be drawn before any row moves. Given those counts, every partition puts its rows in random order
and deals them out; the rows are exchanged once, and each shard puts what it got in random order. The
result is a uniform permutation cut into shards whose sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.session import staged

#: About so many rows are ordered in one task, and the most partitions that are drawn for; beyond a thousand
#: million rows partitions grow instead, and Spark sorts them with spills.
PART_ROWS, MOST_PARTS = 50_000, 20_000
_COPIES = 1 << 16


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good`` and ``bad`` ones are good; no number is too large.

    Chances relative to the likeliest count follow from ratios of neighbours, as far as they are above 1e-16
    of it or so.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    top = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))
    reach = int(12 * spread) + 40
    up = np.arange(top, min(high, top + reach), dtype=np.float64)
    down = np.arange(top, max(low, top - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    fall = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    chances = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    at = int(np.searchsorted(chances, rng.random() * chances[-1], "right"))
    return top - len(fall) + min(at, len(chances) - 1)


def matrix(rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts from each partition to each shard: row sums as given, column sums one apart at most."""
    total = sum(rows)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng, out = np.random.default_rng(seed), np.zeros((len(rows), n_shards), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for s in range(n_shards):
            rest -= left[s]
            out[i, s] = _drawn(rng, left[s], rest, n)
            n -= int(out[i, s])
            left[s] -= int(out[i, s])
    return out


def _table(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    """One row a partition: ``upto``, the running counts over its shards."""
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(counts.cumsum(axis=1))]
    return spark.createDataFrame(rows, "part int, upto array<long>")


def shuffle_rows(docs: DataFrame, n_shards: int = 8, *, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard and its place there.

    Returns doc_id, size (UTF-8 bytes of the text and one), text_crc32, shard and slot (0, 1, ... in
    each shard without gaps). The order depends on the seed and the rows alone, never on how they are
    stored, so a task run again deals the same. A null text counts as empty, a null doc_id is a value
    like any other, rows that are equal are counted before they move and then spread like others. No
    rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    columns = rows.columns
    # Equal rows as one row and a count; the copies come back in two steps of bounded arrays.
    counted = rows.groupBy(*columns).agg((F.count("*") - 1).alias("last"))
    blocks = F.explode(F.expr(f"sequence(0L, last div {_COPIES})"))
    copies = F.expr(f"sequence(0L, if(block < last div {_COPIES}, {_COPIES - 1}L, last % {_COPIES}))")
    each = counted.select(*columns, "last", blocks.alias("block")).select(
        *columns, "block", F.explode(copies).alias("copy")
    )
    row_hash = [F.xxhash64(F.lit(seed + k), *columns, "block", "copy") for k in range(3)]
    n = docs.count()
    n_parts = min(1 + n // PART_ROWS, MOST_PARTS)
    placed = each.select(
        *columns,
        F.pmod(row_hash[0], F.lit(n_parts)).cast("int").alias("part"),
        row_hash[1].alias("first"),
        row_hash[2].alias("second"),
    )
    placed = staged(placed, "rows")
    sizes = [0] * n_parts
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row a partition
        sizes[r["part"]] = r["n"]
    dealt = _table(spark, matrix(sizes, n_shards, seed))
    local = Window.partitionBy("part").orderBy("first", "second", *columns)
    sent = (
        placed.withColumn("place", F.row_number().over(local) - 1)
        .join(dealt, "part")
        .withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("place"))))
        .select(*columns, "shard", "second")
    )
    # The second order is by hash; ranges of the hash let many tasks order one shard.
    n_ranges = 1 + n // n_shards // PART_ROWS
    in_range = F.pmod(F.shiftrightunsigned("second", 40), F.lit(n_ranges)).cast("int")
    sent = staged(sent.withColumn("range", in_range), "sent")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sent.groupBy("shard", "range")
        .agg(F.count("*").alias("n"))
        .select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    again = Window.partitionBy("shard", "range").orderBy("second", *columns)
    return (
        sent.withColumn("place", F.row_number().over(again) - 1)
        .join(starts, ["shard", "range"])
        .select(*columns, "shard", (F.col("start") + F.col("place")).alias("slot"))
    )
