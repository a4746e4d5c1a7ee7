"""Small corpora with what real ones hold: nulls, empty and very long texts, copies, shared passages."""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession

#: Columns that operators make themselves, here as columns of the input.
CLASHES = "n_words long, key_ long, shard int, score double, carried string, line string, text_key string"


def frame(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """doc_id and text; with ``clash`` also columns named as the operators' own."""
    if not clash:
        return spark.createDataFrame(rows, "doc_id long, text string")
    extra = (1, 2, 3, 0.5, "x", None, "y")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHES}")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary):x}{rng.choice('aé')}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Copies, near copies, one shared passage, repetition, junk, nulls and one long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 30))
    rows: list[tuple] = []
    for i in range(n):
        kind = i % 8
        body = words(rng, rng.randrange(1, 120))
        if kind == 1 and rows:
            rows.append((i, rng.choice(rows)[1]))
        elif kind == 2 and rows:
            other = (rng.choice(rows)[1] or "a b c").split(" ")
            other[rng.randrange(len(other))] = "edit"
            rows.append((i, " ".join(other)))
        elif kind == 3:
            at = rng.randrange(len(body))
            rows.append((i, " ".join(body[:at]) + f" {passage} " + " ".join(body[at:])))
        elif kind == 4:
            rows.append((i, " ".join(["the"] * rng.randrange(1, 60)) + "\n" + " ".join(body)))
        elif kind == 5:
            rows.append((i, "\t".join(body) + " \x0b\n\n " + rng.choice(string.punctuation)))
        else:
            rows.append((i, " ".join(body)))
    long_ = words(rng, 6000, 50)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, " ".join(long_)), (n + 4, "ÀÉ A1-B2 ABC")]
    rows.append((n + 5, rows[0][1]))
    rng.shuffle(rows)
    return rows
