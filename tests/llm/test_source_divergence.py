import random
from collections import Counter

import pytest
from cases import CLASHES, corpus

from tapeworks.llm.source_divergence import divergence, pieces, terms_of


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if "a" <= c <= "z" or "A" <= c <= "Z" or c > "\x7f":
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(rows, min_docs=3, term_ranks=200):
    docs = [(lang or "", source or "", Counter(terms(t))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in spread.items() if n >= min_docs]
        v = len(kept)

        def shares(held, kept=kept, v=v):
            count = Counter()
            for d in held:
                count.update(d[2])
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}, count

        whole = shares(mine)[0]
        groups = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (p, count) in groups.items():
            pair = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()) for o, (q, _) in groups.items() if o != s]
            over = [(-((p[t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if count[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pair, None), ("term", over, term_ranks)):
                out += [(lang, s, part, x.decode(), -n, r) for r, (n, x) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def run(spark, rows, **more):
    schema = f"text string, lang string, source string, {CLASHES}, term string, n string, p string, value string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 0.5, "x", None, "y", "a", "b", "c", "d") for r in rows], schema)
    return sorted(tuple(r) for r in divergence(docs.repartition(5), **more).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells", [400_000, 100])
def test_matches_brute_force(spark, cells):
    rng = random.Random(7)
    names = ["a", "b", "é", None, "", "Z"]
    rows = [(t, rng.choice(["en", "de", None, ""]), rng.choice(names)) for _, t in corpus(5, 60)]
    rows += [("alpha BETA gamma", "xx", f"s{i}") for i in range(2)] + [("alpha", "xx", None), (None, "yy", "b"), ("1 2", "yy", "c")]
    rows += [("Öl öl ölÖ a1b", "zz", "a"), ("Öl b", "zz", "b"), ("Öl b", "zz", "b"), ("b", "zz", None), ("...", "zz", "none")]
    for kind in range(2):
        assert run(spark, rows, cells=cells, term_ranks=200 if kind else 3) == brute(rows, 3, 200 if kind else 3)


def test_no_rows_and_one_group(spark):
    assert run(spark, []) == []
    assert run(spark, [("a b", "en", "x")] * 3) == brute([("a b", "en", "x")] * 3)


def test_pieces_keep_terms_whole():
    rng = random.Random(1)
    text = "".join(rng.choice("abé  .Z9\n") for _ in range(5000)).encode()
    whole = b" ".join(pieces(text, 64))
    assert whole.split() == next(pieces(text)).split()
    assert terms_of(text) == Counter(x.encode() for x in terms(text.decode()))
