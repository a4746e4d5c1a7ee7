import math
import random

from tapeworks.llm.topk_search import search


def brute(queries, rows, k=5):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = set()
    for q, v in queries:
        if q is None or not good(v):
            continue
        mine = [math.floor(256 * x) for x in v]
        scores = [
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(mine, w)))), i)
            for i, w in whole
            if i != q and len(w) == len(mine)
        ]
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out.add((q, rank, i, -s))
    return out


def run(spark, queries, rows, k=5):
    schema = "vec_id long, embedding array<double>, label int, rank int"
    make = lambda x: spark.createDataFrame([(i, v, 1, 2) for i, v in x], schema)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in search(make(queries), make(rows), k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force(spark, monkeypatch):
    import tapeworks.llm.topk_search as module

    rng = random.Random(2)
    for name, value in (("QUERY_ROWS", 7), ("CANDIDATE_ROWS", 60), ("STEP", 16)):
        monkeypatch.setattr(module, name, value)
    # Clustered vectors let the bounds prune; rounded ones give many ties.
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(6)]
    rows = [(i, [round(c + rng.gauss(0, 0.1), 1) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [math.nan] * 24), (403, [math.inf] * 24), (None, [1.0] * 24)]
    rows += [(500, []), (501, []), (502, [0.5]), (503, [-0.5])]
    queries = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 400]
    assert run(spark, queries, rows) == brute(queries, rows)


def test_few_candidates_large_values_and_no_rows(spark):
    rows = [(1, [1e30, 2.0]), (2, [-1e30, 1.0]), (3, [1e12, -1e12]), (4, [0.0, 0.0])]
    assert run(spark, rows, rows) == brute(rows, rows)
    assert run(spark, [], rows) == set()
    assert run(spark, rows[:1], []) == set()


def test_widest_finite_components(spark):
    df = spark.createDataFrame([(0, [1e307, 1.0]), (1, [1.0, 1.0]), (2, [-1e308, 2.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = search(df.filter("vec_id = 1"), df, 3).collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 2**63 - 1), (3, 2 * 256 * 128), (2, -(2**63))]
