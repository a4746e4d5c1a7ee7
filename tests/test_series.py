import itertools
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.series import (
    block_window, owned, positions, running, salted_lookup, split_series,
)


@pytest.fixture(scope="module")
def points(spark):
    """One key with most of the rows, a few with hardly any; times with long holes."""
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 400), ("b", 37), ("c", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([1, 1, 2, 90])
            rows.append((key, t, i, rng.randint(-9, 9)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")


@pytest.mark.parametrize(("block", "before", "after"), [(8, 5, 0), (16, 40, 3), (10**6, 7, 2)])
def test_bounded_frames_match_whole_series(points, block, before, after):
    rows, df = points
    cut = split_series(df, ["k"], F.floor(F.col("t") / 4), before=before, after=after, block_rows=block)
    w = block_window(["k"], "t")
    cut = positions(cut, ["k"], "t").withColumns(
        {
            "total": F.sum("v").over(w.rowsBetween(-before, after)),
            "idx": F.col("_idx"),
            "blk": F.col("_block"),
        }
    )
    got = {(r.k, r.t): r for r in owned(cut).collect()}
    assert len(got) == len(rows)
    if block < 100:
        assert len({r.blk for r in got.values() if r.k == "hot"}) > 10
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        series = list(group)
        for n, (_, t, i, _v) in enumerate(series):
            r = got[key, t]
            assert r.idx == n == i
            assert r.total == sum(x[3] for x in series[max(0, n - before) : n + after + 1])


def test_running_matches_loops(points):
    rows, df = points
    measures = {
        "s": ("sum", F.col("v")),
        "n": ("count", F.lit(1)),
        "hi": ("max", F.col("v")),
        "lo": ("min", F.col("v")),
        "odd": ("last", F.when(F.col("v") % 2 != 0, F.col("v"))),
        "nxt": ("next", F.when(F.col("v") % 2 != 0, F.col("v"))),
    }
    bucket = F.floor(F.col("t") / 5)
    for inclusive in (True, False):
        out = running(df, ["k"], ["t"], bucket, measures, include_current=inclusive)
        got = {(r.k, r.t): r for r in out.collect()}
        for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
            series = list(group)
            for n, row in enumerate(series):
                r = got[key, row[1]]
                seen = [x[3] for x in series[: n + inclusive]]
                odd = [x for x in seen if x % 2]
                later = [x[3] for x in series[n + 1 :] if x[3] % 2]
                assert (r.s or 0) == sum(seen) and (r.n or 0) == len(seen)
                assert r.hi == (max(seen) if seen else None) and r.lo == (min(seen) if seen else None)
                assert r.odd == (odd[-1] if odd else None) and r.nxt == (later[0] if later else None)


def test_salted_lookup_keeps_every_row_once(spark, points):
    _, df = points
    small = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, tag int")
    out = salted_lookup(df, small, ["k"], salts=5)
    counts = {r.tag: r["count"] for r in out.groupBy("tag").count().collect()}
    assert counts == {1: 400, 2: 37, None: 1}
