import random

import numpy as np
import pytest
from cases import corpus, frame, words

from tapeworks.llm import ngram_join
from tapeworks.llm.components import Groups, components


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=3, least=90):
    sets, groups = [shingles(t, size) for _, t in rows], Groups()
    ids = [(i is not None, i or 0) for i, _ in rows]
    for a, x in enumerate(sets):
        for b in range(a):
            both = len(x & sets[b])
            if x and 100 * both >= least * (len(x) + len(sets[b]) - both):
                groups.join((ids[a], a), (ids[b], b))
    out = []
    for n, (i, _) in enumerate(rows):
        top = min(m[0] for m in map(groups.find, [(ids[n], n)]))
        out.append((ids[n], len(sets[n]), top))
    return sorted(out)


def run(spark, rows, **more):
    got = ngram_join.jaccard_groups(frame(spark, rows, clash=True).repartition(3), **more).collect()
    pair = lambda x: (x is not None, x or 0)
    return sorted((pair(r.doc_id), r.n_shingles, pair(r.component_id)) for r in got)


def near_copies(seed):
    """Groups whose members lie on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        body = words(rng, rng.choice([4, 12, 40, 150, 400]), 5000)
        for k in range(14):
            copy = list(body)
            for _ in range(rng.randrange(0, max(2, len(body) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
            if rng.random() < 0.3:
                copy = copy[: -rng.randrange(1, 1 + len(copy) // 15)] if len(copy) > 15 else copy
            rows.append((100 * g + k, " ".join(copy).upper() if k % 5 == 0 else " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1000, 5])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BIN_SETS", 10)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 20_000)
    rows = near_copies(block) + [(5000 + i if i is not None else None, t) for i, t in corpus(2)]
    rows += [(9000, "a"), (9001, "A"), (9002, "a b"), (9003, "a b a b a b"), (9004, "a b a"), (None, "a")]
    assert run(spark, rows) == brute(rows)


def test_other_sizes_and_thresholds(spark):
    rows = near_copies(3)[:40]
    assert run(spark, rows, size=5, least=80) == brute(rows, 5, 80)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_similar_sets_share_a_class():
    rng, bands = np.random.default_rng(1), ngram_join.Bands(90)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 9 + 1))
        other = np.concatenate([base[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 12 + 1)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            shared = set(ngram_join.class_hashes(a, bands).tolist()) & set(ngram_join.class_hashes(b, bands).tolist())
            assert shared


def test_only_similar_sets_share_a_class_at_four_fifths():
    rng, bands, met = np.random.default_rng(4), ngram_join.Bands(80), {}
    for i in range(300):
        n = int(rng.integers(20, 600))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        new = rng.integers(0, 2**63, n // 9 if i % 2 else 0, dtype=np.uint64)
        other = np.unique(np.concatenate([base[len(new) :], new]))
        both = len(np.intersect1d(base, other))
        mine = set(ngram_join.class_hashes(base, bands).tolist())
        if 100 * both >= 80 * (len(base) + len(other) - both):
            assert mine & set(ngram_join.class_hashes(other, bands).tolist())
        for x in mine:
            met.setdefault(x, []).append(i)
    assert len({i for x in met.values() if len(x) > 1 for i in x}) < 60


def test_search_finds_all_overlaps():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.choice(2**40, 260, replace=False)).astype(np.uint64)
    sets = [np.sort(rng.choice(pool, int(rng.integers(200, 256)), replace=False)) for _ in range(60)]
    index = ngram_join.Index(sets, 80)
    for x in sets:
        want = []
        for i, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                want.append(i)
        assert sorted(index.search(x, np.zeros(len(sets), bool))) == want


def test_components(spark):
    rng, groups = random.Random(3), Groups()
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges += [(1000, i) for i in range(1001, 1100)] + [(-5, 7), (3, 3)]
    for a, b in edges:
        groups.join(a, b)
    want = {x: groups.find(x) for x in list(groups.up) if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = components(df).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_ids_keep_texts_apart(spark):
    rng = random.Random(8)
    x, y = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(1, " ".join(x)), (5, " ".join(x[:-1])), (5, " ".join(y)), (9, " ".join(y[:-1]))]
    got = ngram_join.jaccard_groups(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 5), (9, 5)]


def test_crowded_class_hashes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWDED", 4)
    rows = near_copies(6)
    assert run(spark, rows, size=5, least=80) == brute(rows, 5, 80)


def test_parity_maps_never_rule_out_a_link():
    rng, bands = np.random.default_rng(5), ngram_join.Bands(80)
    for _ in range(300):
        n = int(rng.integers(4, 3000))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        new = rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 2)), dtype=np.uint64)
        other = np.unique(np.concatenate([base[int(rng.integers(0, n // 9 + 1)) :], new]))
        both = len(np.intersect1d(base, other))
        maps = [ngram_join.parity_map(x, bands) for x in (base, other)]
        may = ngram_join.ParityMaps(maps, np.array([len(base), len(other)]), 80).may_link(0, np.array([1]))[0]
        assert may or 100 * both < 80 * (len(base) + len(other) - both)
