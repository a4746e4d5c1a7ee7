import hashlib
import re

from cases import corpus, frame

from tapeworks.llm.substring_dedup import Automaton, remove_repeats


def brute(rows, window=20):
    docs = sorted((d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows)
    seen, out = set(), {}
    for doc_id, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force(spark, monkeypatch):
    import tapeworks.llm.substring_dedup as module

    rows = corpus(3, 60)
    # Tiny batches and shards, and anchors settled inside a batch, take every path.
    for name, value in (("BUCKET_BYTES", 5000), ("SHARD_BYTES", 4000), ("ASKED", 20)):
        monkeypatch.setattr(module, name, value)
    df = frame(spark, rows, clash=True).repartition(3)
    assert found(remove_repeats(df)) == brute(rows)


def test_repeated_words_and_short_windows(spark):
    rows = [(1, "a " * 50), (2, "a " * 25 + "b"), (3, "b " + "a " * 25), (4, "a b " * 30), (5, "b a " * 12)]
    assert found(remove_repeats(frame(spark, rows))) == brute(rows)
    assert found(remove_repeats(frame(spark, rows), window=8, gram=3)) == brute(rows, 8)


def test_null_ids_and_rows_that_repeat(spark):
    text = " ".join(f"x{i}" for i in range(25))
    rows = [(None, text), (1, text), (1, text), (2, text + " y")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    # The row without id comes first and keeps its words.
    assert got == [(0, 0), (1, 25), (1, 25), (2, 25)]


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    got = remove_repeats(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r.n_words, r.n_removed, r.text) for r in got] == [(0, 0, "")] * 2


def test_automaton_first_ends():
    a = Automaton()
    a.add([1, 2, 3, 1, 2, 4])
    assert list(a.matches([1, 2, 9, 2, 3, 1], 2)) == [(0, 1), (3, 2), (4, 3)]
