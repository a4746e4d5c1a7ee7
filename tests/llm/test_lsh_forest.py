import random

import numpy as np
import pytest
from cases import corpus, frame, words
from test_ngram_join import brute, near_copies, shingles

from tapeworks.llm import lsh_forest


def run(spark, rows, **more):
    got = lsh_forest.near_groups(frame(spark, rows, clash=True).repartition(3), **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    pair = lambda x: (x is not None, x or 0)
    return sorted((pair(r.doc_id), r.n_shingles, pair(r.component_id)) for r in got)


def star(seed, n):
    """Copies of one text that are like it, but mostly not like each other."""
    rng = random.Random(seed)
    body = words(rng, 150, 5000)
    rows = [(7000, " ".join(body))]
    for i in range(n):
        copy = list(body)
        for at in rng.sample(range(150), 8):
            copy[at] = f"s{i}x{at}"
        rows.append((7001 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lsh_forest, "BLOCK", 1500)
        monkeypatch.setattr(lsh_forest, "TASK", 2000)
        monkeypatch.setattr(lsh_forest, "TASK_ROWS", 100)
        monkeypatch.setattr(lsh_forest, "CROWDED", 6)
    rows = near_copies(4) + [(5000 + i if i is not None else None, t) for i, t in corpus(2)] + star(1, 50)
    rows += [(9000, "a"), (9001, "A"), (9002, "a b"), (9003, "a b a b a b"), (9004, "a b a"), (9010, " \n"), (9011, None)]
    assert run(spark, rows, size=2, least=80) == brute(rows, 2, 80)


def test_words_five_at_least_four_fifths(spark):
    rows = near_copies(3)[:40] + [(None, "a b c d e f g h"), (9005, "A B C D E F G H i")]
    assert run(spark, rows) == brute(rows, 5, 80)


def test_shared_ids_keep_texts_apart(spark):
    rng = random.Random(8)
    x, y = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(1, " ".join(x)), (5, " ".join(x[:-1])), (5, " ".join(y)), (9, " ".join(y[:-1])), (5, " ".join(y))]
    got = lsh_forest.near_groups(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (9, 5, False)
    ]


def test_no_rows_and_none_alike(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (4, "g h i j k l")]
    assert run(spark, rows) == brute(rows, 5, 80)


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both = rng.integers(1, 2**63, int(400 * share), dtype=np.uint64)
            one, two = (np.concatenate([both, rng.integers(1, 2**63, int(200 * (1 - share)), dtype=np.uint64)]) for _ in range(2))
            errors.append((lsh_forest.signature(one) == lsh_forest.signature(two)).mean() - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_a_star_is_found_from_any_side():
    sets = [np.array(sorted(hash(x) % 2**63 for x in shingles(t, 2)), np.uint64) for _, t in star(3, 30)]
    for turn in range(3):
        pairs, best = lsh_forest.inner_links(sets[turn:] + sets[:turn], 80)
        assert len(pairs) == 30 and best[0] in (0, (len(sets) - turn) % len(sets), *best)


def test_a_crowded_region_parts_no_likely_pair(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "CROWDED", 8)
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 2**16, (30, lsh_forest.COMPONENTS)).astype("<u2")
    # Two that agree in 97 of 128 parts, but of all prefixes only in the shortest one of the first tree.
    marks[1] = marks[0]
    marks[1, 7::4] += 1
    marks[:, :5] = marks[0, :5]
    rows = [(i, bytearray(m.tobytes())) for i, m in enumerate(marks)]
    found = lsh_forest.forest(spark.createDataFrame(rows, "node long, signature binary"), 80).collect()
    assert {tuple(sorted((r.u, r.v))) for r in found} == {(0, 1)}
