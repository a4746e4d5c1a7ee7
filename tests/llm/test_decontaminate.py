import random
import re

from cases import corpus, frame, words

from tapeworks.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(rows, items, window=10):
    windows = {}
    for item, t in items:
        w = split(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, named = split(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    named |= found
        names = sorted(str(x) for x in named if x is not None)
        out.append((str(i), len(w), len(hit), names, bool(hit)))
    return sorted(out)


def run(spark, docs, items, **more):
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    got = contamination(frame(spark, docs, clash=True), bench, **more).collect()
    assert all(r.n_items == len(r["items"]) for r in got)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.choice([1, 3, 9, 10, 11, 25]), 60))) for k in range(20)]
    items += [(30, None), (31, ""), (32, "?!"), (33, items[0][1]), (33, items[2][1]), (None, "lone words of no item")]
    items += [(40, "The the THE the the the the the the the the the"), (41, "É É É É É É É É É É"), (42, "zz9")]
    rows = corpus(8)
    for k in range(30):
        w = words(rng, rng.randrange(0, 40), 60)
        at, text = rng.randrange(len(w) + 1), (rng.choice(items)[1] or "").split(" ")
        cut = slice(rng.randrange(2), None if rng.random() < 0.6 else rng.randrange(1, 12))
        joined = rng.choice([" ", "-", "\n", " ... "]).join(w[:at] + text[cut] + w[at:])
        rows.append((1000 + k, joined.upper() if k % 3 else joined))
    rows += [(2000, "the " * 30), (2001, "é é é é é é é é é é é"), (2002, "É " * 12), (None, items[5][1]), (2003, "--zz9--")]
    rows.append(rows[-1])
    assert run(spark, rows, items) == brute(rows, items)
    # Several rounds of small broadcasts.
    assert run(spark, rows, items, rows=7) == brute(rows, items)
    assert run(spark, rows, items, window=3) == brute(rows, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b"), (2, None)], []) == [("1", 2, 0, [], False), ("2", 0, 0, [], False)]
