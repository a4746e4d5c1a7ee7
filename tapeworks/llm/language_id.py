"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent letter n-grams (one to three letters,
word ends marked). A document is ranked the same way and compared with every profile: each of its
n-grams adds the distance between its two places, or the most possible where the profile lacks it. The
language with the smallest sum wins, ties going to the name that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: n-grams in a profile.
PROFILE = 300
#: At most about so many documents of each language are learned from.
LEARN_DOCS = 5000

_EDGE = 1  # stands for any run of what is not a letter


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is not a letter."""
    found = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            found[point] = ord(char.lower()[0])
    return found


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers (21 bits a letter); empty if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[np.minimum(points, 0x10FFFF)]
    keep = x > 0
    if not keep.any():
        return np.empty(0, np.int64)
    after = keep.copy()
    after[1:] |= keep[:-1]
    x = x[after].astype(np.int64)
    x[x == 0] = _EDGE
    ends = [np.array([_EDGE], np.int64)]
    x = np.concatenate([*(ends if x[0] != _EDGE else []), x, *(ends if x[-1] != _EDGE else [])])
    pairs = x[:-1] << 21 | x[1:]
    return np.concatenate([x[x != _EDGE], pairs, pairs[:-1] << 21 | x[2:]])


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order of rank; equal counts in order of the n-gram."""
    keys, counts = np.unique(grams, return_counts=True)
    return keys[np.lexsort((keys, -counts))[:most]]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter by the crc32 of the id, and those without id."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(True))


def last_hash(most: int, n: int) -> int:
    """The 64-bit hash up to which a share of ``most`` of ``n`` rows lies, however many there are."""
    return -(2**63) - 1 + max(1, min(2**64, most * 2**64 // n))


def learn(
    docs: DataFrame, *, profile: int = PROFILE, most_docs: int = LEARN_DOCS
) -> dict[str, list[int]]:
    """Profiles from the text and lang of ``docs``; rows with a null in either teach nothing.

    Of a language with more than ``most_docs`` documents a share is taken by a hash of the id, so that
    about ``most_docs`` are read. Counts are summed in each batch, then by Spark; only the profiles,
    ``profile`` numbers a language, reach the driver.
    """
    labelled = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string"), "text"
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    upto = F.lit(0)
    for lang, n in sorted(sizes.items()):
        upto = F.when(F.col("lang") == lang, F.lit(last_hash(most_docs, n))).otherwise(upto)
    taken = labelled.filter(F.xxhash64("id") <= upto).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text"), strict=True):
                found.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, grams in found.items():
                keys, counts = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                    ["lang", "gram", "n"],
                )

    summed = (
        taken.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= profile)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], most: int):
        self.langs, self.most = sorted(profiles), most
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.places = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(profiles[lang], np.int64))
            self.places[i, at] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(grams, self.most)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        places = np.where(self.grams[at] == mine, self.places[:, at], -1)
        apart = np.where(places < 0, self.most, np.abs(places - np.arange(len(mine))))
        sums = apart.sum(axis=1)
        best = int(sums.argmin())
        return self.langs[best], float(1 - sums[best] / (self.most * len(mine)))


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    *,
    profile: int = PROFILE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """lang_pred and score (1: the ranks agree, 0: no n-gram in common) of every row of ``docs``.

    Only the text is looked at, and the whole of it. A null text, a text without letters, or no
    profiles give ``und`` and 0. ``carry`` names columns to return in the struct ``carried``; other
    columns are not read. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    if carry:
        columns.append(F.struct(*carry).alias("carried"))
    rows = docs.select(*columns)
    kinds = {"doc_id": "long", "lang_pred": "string", "score": "double"}
    if carry:
        kinds["carried"] = rows.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value, profile)
        for batch in batches:
            found = [classify(x.as_py()) for x in batch.column("text")]
            arrays = [
                batch.column("doc_id"),
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
            ]
            if carry:
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
