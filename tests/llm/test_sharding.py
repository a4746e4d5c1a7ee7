import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import corpus, frame

from tapeworks.llm import sharding


def test_matrix_has_exact_margins():
    rows = [0, 7, 100, 3, 51]
    counts = sharding.matrix(rows, 8, 1)
    assert counts.sum(axis=1).tolist() == rows
    sizes = counts.sum(axis=0)
    assert sizes.sum() == sum(rows) and sizes.max() - sizes.min() <= 1 and (counts >= 0).all()


def test_matrix_follows_the_law():
    # Two rows of one partition, two of another, two shards: 0, 1, 2 in the first with 1/6, 4/6, 1/6.
    seen = Counter(int(sharding.matrix([2, 2], 2, s)[0, 0]) for s in range(3000))
    assert abs(seen[1] / 3000 - 4 / 6) < 0.04 and abs(seen[0] / 3000 - 1 / 6) < 0.03


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 9)
    monkeypatch.setattr(sharding, "_COPIES", 4)
    rows = corpus(9, 60) + [(None, "x"), (None, None)] + [(500, "copy")] * 37
    df = frame(spark, rows, clash=True)
    got = sharding.shuffle_rows(df, 8, seed=3).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # The same rows stored otherwise are dealt the same.
    again = sharding.shuffle_rows(df.repartition(5), 8, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    other = sharding.shuffle_rows(df, 8, seed=4).collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_places_are_uniform(spark):
    df = spark.range(40).selectExpr("id AS doc_id", "'' AS text")
    shards = np.zeros((40, 4))
    for seed in range(12):
        for r in sharding.shuffle_rows(df, 4, seed=seed).collect():
            shards[r.doc_id, r.shard] += 1
    # Each row lands in each shard with 1/4: chi-square of 120 degrees of freedom.
    assert ((shards - 12 / 4) ** 2 / (12 / 4)).sum() < 200


def test_no_rows(spark):
    assert sharding.shuffle_rows(frame(spark, [])).count() == 0


def test_matrix_beyond_a_thousand_million_rows():
    rows = [2_000_000_000, 1_999_999_993, 0, 7]
    counts = sharding.matrix(rows, 8, 3)
    sizes = counts.sum(axis=0)
    assert counts.sum(axis=1).tolist() == rows and sizes.max() - sizes.min() <= 1 and (counts >= 0).all()
    # Each cell lies within a few standard deviations of its mean.
    assert abs(counts[0, 0] - 250_000_000) < 8 * 2e4


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(5)
    for good, bad, n in [(5, 9, 6), (400, 300, 120), (3, 100_000, 50_000), (10**10, 10**10, 40)]:
        got = np.array([sharding._drawn(rng, good, bad, n) for _ in range(4000)])
        mean = n * good / (good + bad)
        spread = np.sqrt(mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1))
        assert abs(got.mean() - mean) < 5 * spread / np.sqrt(4000) and abs(got.std() / spread - 1) < 0.06
        assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)
