"""The whole pipeline on a small corpus against plain Python."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import test_decontaminate as leaks
import test_line_dedup as lines
import test_ngram_join as near
import tiktoken
from cases import words

from tapeworks.llm.byte_bpe import read_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    shared = "This line stands in many documents of the small corpus."
    item = " ".join(words(rng, 14))
    rows = []
    for i in range(60):
        body = words(rng, rng.randrange(20, 80))
        text = " ".join(body[:10]) + "\n" + " ".join(body[10:])
        if i % 7 == 0:
            text += "\n" + shared
        if i % 11 == 3:
            text += f"\nsee {item} here"
        if i % 13 == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text))
    rows += [(70, None), (71, ""), (72, "12 34 -- 56"), (73, rows[4][1]), (4, rows[4][1])]
    return rows, [(1, item), (2, "words that no text has in this order at all")]


def brute(rows, items):
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    kept = [(i, text) for _, i, text, _, _ in lines.brute(kept)]
    kept = sorted(set(kept))  # rows equal in id and text are one document
    groups = near.brute(kept, 5, 80)
    kept = [r for r, (own, n, top) in zip(kept, groups, strict=True) if not n or own == top]
    dirty = {x[0] for x in leaks.brute(kept, items) if x[4]}
    return [(i, t) for i, t in kept if str(i) not in dirty]


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows, items = corpus()
    full = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in brute(rows, items):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        want.append((i, len(ids) // 4, ids, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == sorted(want)
    assert 30 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows[:20]], SCHEMA + ", more int")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and 0 < out.count() <= 20
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_copies_at_five_words_and_four_fifths(spark, tmp_path):
    rng, rows = random.Random(5), []
    for g in range(8):
        body = words(rng, 100, 5000)
        for k in range(6):
            copy = list(body)
            for at in rng.sample(range(5, 95), k):
                copy[at] = f"edit{g}x{k}x{at}"
            rows.append((10 * g + k, " ".join(copy)))
    groups = near.brute(rows, 5, 80)
    want = [i for (i, _), (own, _, top) in zip(sorted(rows), groups, strict=True) if own == top]
    stricter = [own[1] for own, _, top in near.brute(rows) if own == top]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == want
    assert 8 <= len(want) < len(stricter)
