import random
from itertools import permutations

import numpy as np
from cases import CLASHES, corpus

from tapeworks.llm.filter_audit import audit, contract

BLANK = " \t\n\x0b\x0c\r"


def split(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    """Every order is run through document by document."""
    body = [t or "" for _, t, _ in rows]
    key = [(i is not None, i or 0) for i, _, _ in rows]
    fails = []
    for n, text in enumerate(body):
        w = split(text)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": any(body[m] == text and key[m] < key[n] for m in range(len(rows))),
        })
    parts = [lang or "" for _, _, lang in rows]
    good = [any(i == j and i is not None and q == 1 for j, q, _ in labels) for i, _, _ in rows]
    toxic = [any(i == j and i is not None and t == 1 for j, _, t in labels) for i, _, _ in rows]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        left = set(range(len(rows)))
        for step, x in enumerate(order, 1):
            gone = {n for n in left if fails[n][x]}
            for p in set(parts):
                mine = [n for n in range(len(rows)) if parts[n] == p]
                out[p, order, step] = [
                    sum(n in left - gone for n in mine), sum(n in gone for n in mine),
                    sum(fails[n][x] and n not in left for n in mine),
                    sum(fails[n][x] and sum(fails[n].values()) == 1 for n in mine),
                    sum(n in gone and good[n] for n in mine), sum(n in gone and toxic[n] for n in mine),
                ]
            left -= gone
    total = {}
    for (p, order, step), v in out.items():
        total[p, order[step - 1]] = total.get((p, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    extra = (1, 2, 3, 0.5, "x", None, "y")
    schema = f"doc_id long, text string, lang string, {CLASHES}, part string, fails int, good int, digest string"
    docs = spark.createDataFrame([(*r, *extra, "p", 1, 2, "d") for r in rows], schema)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = audit(docs.repartition(5), marks).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in corpus(3, 60)]
    long_ = " ".join(f"w{i}" for i in range(250))
    rows += [(200 + i, long_, "en") for i in range(6)] + [(300, long_.upper(), "de"), (301, long_ + " #", "xx")]
    rows += [(400, "a b " * 150, "en"), (401, "É" * 10 + "AB" + "é" * 60, None), (202, long_, "de"), (202, long_, "en")]
    rows += [(None, long_, "en"), (None, None, "de"), (None, "", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 410, 2)]
    labels += [(202, 1, 0), (202, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    assert run(spark, [(1, "a", "en")], []) == brute([(1, "a", "en")], [])


def test_contraction_takes_pass_fail_or_all():
    tensor = np.random.default_rng(1).integers(0, 9, (3, 2, 2, 2, 2, 2))
    found = contract(tensor)
    assert found[0, 2, 2, 2, 2, 2] == tensor[0].sum()
    assert found[1, 0, 1, 2, 2, 0] == tensor[1, 0, 1, :, :, 0].sum()
