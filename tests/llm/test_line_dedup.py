import random

import numpy as np
from cases import frame

from tapeworks.llm.line_dedup import TwoFilters, dedup_lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=40, min_docs=5):
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append((i is not None, i or 0))
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), (i is not None, i or 0)) == (i is not None, i or 0)]
        out.append((i is not None, i or 0, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def run(spark, rows, **more):
    got = dedup_lines(frame(spark, rows, clash=True).repartition(3), bits=1 << 12, **more).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    shared = ["Licence line number %d, which many documents of this corpus repeat" % i for i in range(6)]
    shared.append("é" * 39)
    shared.append("É" * 40)
    rows = []
    for i in range(60):
        lines = ["own line %d.%d of a document, long enough to count as a line" % (i, k) for k in range(rng.randrange(4))]
        lines += [rng.choice(["  %s\t", "%s", "%s \r"]) % rng.choice(shared) for _ in range(rng.randrange(5))]
        lines += [rng.choice(shared).upper() if rng.random() < 0.3 else "", "short"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (59, shared[1]), (103, "x" * 300_000)]
    rows.append(rows[3])
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_chars=3, min_docs=2) == brute(rows, 3, 2)


def test_full_filters_only_cost_traffic(spark):
    rows = [(i, f"line {i % 50} of a table that the tiny filters can not tell apart at all") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_no_rows_and_carried_columns(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a")], clash=True)
    assert dedup_lines(df, carry=df.columns).select("carried.*").columns == df.columns


def test_filters_know_what_was_put_twice():
    filters, hashes = TwoFilters(1 << 10), np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    filters.add(hashes)
    filters.add(hashes[:20])
    assert filters.known(filters.again, hashes[:20]).all()
    assert filters.known(filters.once, hashes).all()
