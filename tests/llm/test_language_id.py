import os
import random
import zlib
from collections import Counter

import pytest
from cases import frame

from tapeworks.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def test_plain_profile_distance():
    profiles = {"aa": lid.ranked(lid.ngrams("aba abab baba"), 300).tolist(), "zz": lid.ranked(lid.ngrams("zyz zyzy"), 300).tolist()}
    classify = lid.Classifier(profiles, 300)
    assert classify("ABA!")[0] == "aa" and classify("zy")[0] == "zz"
    # Every n-gram unknown: as far from both; the first name wins with score 0.
    assert classify("qqq") == ("aa", 0.0)
    assert classify(None) == classify("") == classify("12 !?\n") == ("und", 0.0)
    assert lid.Classifier({}, 300)("abc") == ("und", 0.0)
    assert classify("aba abab baba") == ("aa", 1.0)


def test_ngrams_mark_word_ends():
    x, e = ord("x"), 1
    assert sorted(lid.ngrams("X, x").tolist()) == sorted(
        [x, x, e << 21 | x, x << 21 | e, e << 21 | x, x << 21 | e]
        + [e << 42 | x << 21 | e, x << 42 | e << 21 | x, e << 42 | x << 21 | e]
    )


def test_rows_and_carried_columns(spark):
    df = frame(spark, [(1, "abc"), (2, None), (None, "  "), (1, "abc"), (3, "é" * 200_000)], clash=True)
    profiles = {"l": lid.ranked(lid.ngrams("abc"), 300).tolist()}
    got = lid.identify(df, profiles, carry=df.columns)
    assert got.select("carried.*").columns == df.columns
    assert sorted((r.doc_id or 0, r.lang_pred, 0 <= r.score <= 1) for r in got.collect()) == [
        (0, "und", True), (1, "l", True), (1, "l", True), (2, "und", True), (3, "l", True),
    ]
    assert lid.identify(frame(spark, []), profiles).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lid.learn(empty) == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lid.identify(docs, lid.learn(docs.filter(~lid.held_out()), most_docs=200)).alias("f")
    held = docs.filter(lid.held_out()).alias("d").join(found, "doc_id")
    n, right = held.count(), held.filter("d.lang = f.lang_pred").count()
    assert n > 200 and right / n > 0.98


def plain_grams(text):
    """n-grams of one to three characters, any run of what is not a letter as one blank."""
    line = " "
    for c in text or "":
        c = c.lower()[0] if c.isalpha() else " "
        line += "" if c == " " and line[-1] == " " else c
    line = line if line[-1] == " " else line + " "
    grams = [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)]
    return [g for g in grams if g != " "] if line != " " else []


def plain_rank(grams, most=300):
    code = lambda g: tuple(1 if c == " " else ord(c) for c in g)

    def number(g):
        out = 0
        for x in code(g):
            out = out << 21 | x
        return out

    count = Counter(grams)
    return sorted(count, key=lambda g: (-count[g], number(g)))[:most]


def test_matches_a_plain_classifier(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdeé", "bb": "cdefgß", "cc": "xyzÀab"}
    rows = []
    for i in range(90):
        lang = rng.choice(list(alphabets))
        text = "".join(rng.choice(alphabets[lang] + "  .\n1") for _ in range(rng.randrange(0, 200)))
        rows.append((i, rng.choice([text, text.upper()]), rng.choice([lang, lang, lang, None])))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 !", "cc"), (203, "qqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = df.filter(~lid.held_out())
    ids = {r.doc_id for r in taught.collect()}
    assert ids == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    profiles = {}
    for lang in alphabets:
        profiles[lang] = plain_rank([g for i, t, x in rows if i in ids and x == lang for g in plain_grams(t)])
    want = {}
    for i, text, _ in rows:
        mine = plain_rank(plain_grams(text))
        sums = {
            lang: sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(mine)) for lang, p in profiles.items()
        }
        best = min(sorted(sums), key=sums.get) if mine else "und"
        want[i] = (best, 1 - sums[best] / (300 * len(mine)) if mine else 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(df, lid.learn(taught)).collect()}
    assert got == want


def test_share_of_any_number_of_documents():
    for n in (1, 4999, 5000, 20_000, 6_000_000_000, 10**15):
        part = (lid.last_hash(5000, n) + 2**63 + 1) / 2**64
        assert lid.last_hash(5000, n) < 2**63 and part > 0 and abs(part * n / min(n, 5000) - 1) < 1e-3
