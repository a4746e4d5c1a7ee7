"""Filter interaction audit: what each filter removes, in every order of the filters.

A document passes or fails each of five filters, whatever the order. So the documents of a part are a
2 x 2 x 2 x 2 x 2 tensor of counts, and every figure of the audit is a contraction of it that takes, along
each axis, those that pass, those that fail, or all. One ``einsum`` gives all of these contractions; the
figures of an order and a step are then looked up. The corpus is read once, and only flags and a digest of
each text move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
_MARKS = b"#$%&*|"
_NOT_CAPITALS = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_MARKS = bytes(x for x in range(256) if x not in _MARKS)
_FOLLOWING = bytes(range(0x80, 0xC0))
#: Counts of a cell: documents, good ones, toxic ones.
_KINDS = ("n", "good", "toxic")
PASS, FAIL, ALL = range(3)
_PICK = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
ORDERS = ["".join(x) for x in permutations(FILTERS)]


def judged(text: bytes) -> int:
    """Bit i is set if the text fails filter i of A to D."""
    words = text.split()
    n = len(words)
    capitals = len(text.translate(None, _NOT_CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * n) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | bool(text.translate(None, _NOT_MARKS)) << 3
    )


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("part"),
                pa.array([judged(x) for x in texts], pa.int32()),
                pa.array([hashlib.sha256(x).digest()[:16] for x in texts], pa.binary()),
            ],
            ["doc_id", "part", "fails", "digest"],
        )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits A to E), n, good, toxic: the tensors of all parts, as rows of their filled cells."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    # Rows without an id have no label; apart, they are no burden to one task of the join.
    own, nameless = (
        rows.filter(x).mapInArrow(_flags, "doc_id long, part string, fails int, digest binary")
        for x in ("doc_id IS NOT NULL", "doc_id IS NULL")
    )
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id_")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"),
    )
    zero = [F.lit(0).cast("long").alias(k) for k in _KINDS[1:]]
    named = own.join(known, F.col("doc_id") == F.col("id_"), "left").drop("id_").na.fill(0, ["good", "toxic"])
    rows = named.unionByName(nameless.select("*", *zero))
    # Copies of a text are counted by id before they meet, then by text and part: a group of copies is a few
    # rows for each task that holds some of them.
    like = ["digest", "part", "fails", "good", "toxic"]
    rows = rows.groupBy(*like, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct("doc_id", "n"))  # a null id comes first
    held = rows.groupBy(*like).agg(first.alias("first"), F.sum("n").alias("n"))
    # What is left of a text is a row for each part and label.
    least = F.min(F.struct("first.doc_id")).over(Window.partitionBy("digest"))
    fresh = F.col("first.doc_id").eqNullSafe(F.col("least.doc_id"))
    both = held.withColumn("least", least).groupBy(*like[1:]).agg(
        F.sum(F.when(fresh, F.col("first.n")).otherwise(0)).alias("kept"), F.sum("n").alias("n")
    )
    late = F.array(
        F.struct(F.col("fails"), F.col("kept").alias("n")),
        F.struct(F.col("fails").bitwiseOR(F.lit(16)).alias("fails"), (F.col("n") - F.col("kept")).alias("n")),
    )
    split = both.select("part", "good", "toxic", F.inline(late))
    return split.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * F.col(k)).alias(k) for k in _KINDS[1:]],
    )


def _lookups() -> list[tuple[str, int, int, dict[str, tuple[int, ...]]]]:
    out = []
    for order in ORDERS:
        for step, letter in enumerate(order, 1):
            this, before = FILTERS.index(letter), [FILTERS.index(x) for x in order[: step - 1]]
            pick = {k: [ALL] * 5 for k in ("kept", "removed", "fails", "alone")}
            for axis in before:
                pick["kept"][axis] = pick["removed"][axis] = PASS
            pick["kept"][this] = PASS
            pick["removed"][this] = pick["fails"][this] = FAIL
            pick["alone"] = [FAIL if axis == this else PASS for axis in range(5)]
            out.append((order, step, this, {k: tuple(v) for k, v in pick.items()}))
    return out


_STEPS = _lookups()
_OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def contract(tensor: np.ndarray) -> np.ndarray:
    """Sums of (kind, 2, 2, 2, 2, 2) for every choice of pass, fail or all along each axis."""
    return np.einsum("tabcde,ia,jb,kc,ld,me->tijklm", tensor, *[_PICK] * 5, optimize=True)


def _audit_part(table: pa.Table) -> pa.Table:
    tensor = np.zeros((3, 32), np.int64)
    at = np.asarray(table.column("fails"))
    for kind, name in enumerate(_KINDS):
        tensor[kind, at] = np.asarray(table.column(name))
    # Bit 0 is filter A: the last axis of the plain order becomes the first one.
    found = contract(tensor.reshape(3, *[2] * 5).transpose(0, 5, 4, 3, 2, 1))
    rows, total = [], [0] * 5
    for order, step, this, pick in _STEPS:
        removed = int(found[(0, *pick["removed"])])
        total[this] += removed
        rows.append(
            (order, step, int(found[(0, *pick["kept"])]), removed, int(found[(0, *pick["fails"])]) - removed,
             int(found[(0, *pick["alone"])]), int(found[(1, *pick["removed"])]), int(found[(2, *pick["removed"])]))
        )
    out = list(zip(*rows, strict=True))
    part = table.column("part")[0].as_py()
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
    arrays = [pa.array([part] * len(rows), pa.string()), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]]
    arrays.append(pa.array([total[this] for _, _, this, _ in _STEPS], pa.int64()))
    return pa.table(arrays, names=[x.split()[0] for x in _OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters A to E and step, with what that step does.

    A part is a lang; null and the empty text are one part. A text fails A with under 200 words, B if 100
    times its distinct words are under 50 times its words, C if 100 times its letters A-Z are over 3 times its
    code points, D if it holds one of ``#$%&*|``, and E if a smaller doc_id holds the same text. Words are runs
    of characters that are not ASCII white space. A null text is empty: it fails A, and E if not the first
    empty one. A null doc_id is smaller than any other and has no label. Rows with one id and text are
    documents of their own, none later than the other; rows with one id share its labels; of several labels of
    an id, one that says so makes it good or toxic. No documents give no rows. Other columns are not read.
    """
    return cells(docs, labels).groupBy("part").applyInArrow(_audit_part, _OUT)
