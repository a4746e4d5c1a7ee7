"""Exact top-k by inner product, with bounds from segment means and deviations.

A vector is cut into segments at several resolutions. Per segment, the mean and the norm of the
deviations from it bound the inner product from above (which bounds the distance from below): the means'
product is exact, the deviations' product is at most the product of their norms. Candidates that a
coarse bound can't rule out are tried with a finer one; the exact product is computed for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one cell of the grid of query blocks and candidate blocks.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
#: Segments of each resolution, coarse to fine.
SEGMENTS = (1, 4, 16)
#: Candidates tried at a time, so that the k-th best found so far rules out the next ones.
STEP = 1024
_EXACT = 2.0**53
_LONG = 2**63 - 1
#: Components beyond this count as this, so that squares stay finite; their scores are beyond a long anyway.
_WIDEST = 1e150


def _statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a dot product is the bound."""
    parts = []
    for part in np.array_split(rows, min(segments, rows.shape[1]), axis=1):
        size = part.shape[1]
        mean = part.mean(axis=1)
        away = part - mean[:, None]
        parts += [mean * np.sqrt(size), np.sqrt((away * away).sum(axis=1))]
    return np.array(parts).T


class Searcher:
    """The ``k`` best of the candidates shown so far, for a block of queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.largest = np.abs(rows).max(initial=0.0)
        self.levels = [_statistics(rows, s) for s in SEGMENTS] if rows.shape[1] else []
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        self.norms = np.sqrt((rows * rows).sum(axis=1))

    def _products(self, rows: np.ndarray) -> np.ndarray:
        """Exact integers, whatever their size."""
        bound = self.largest * np.abs(rows).max(initial=0.0) * max(1, rows.shape[1])
        if bound < _EXACT:
            return self.rows @ rows.T
        whole = np.array([[int(x) for x in r] for r in self.rows.tolist()], object)
        other = np.array([[int(x) for x in r] for r in rows.tolist()], object)
        return np.clip(whole @ other.T, -_LONG - 1, _LONG)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates in order of id: one that equals the k-th best comes too late."""
        alive = self.ids[:, None] != ids[None, :]
        norms = np.sqrt((rows * rows).sum(axis=1))
        # What rounding may take from a bound.
        slack = 1e-9 * self.norms[:, None] * norms[None, :] + 1e-6
        for i, mine in enumerate(self.levels):
            if not np.isfinite(self.floor).any():
                break
            theirs = _statistics(rows, SEGMENTS[i])
            alive &= mine @ theirs.T + slack > self.floor[:, None]
            if not alive.any():
                return
        asked, shown = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        part = Searcher.__new__(Searcher)
        part.rows, part.largest = self.rows[asked], self.largest
        scores = part._products(rows[shown])
        alive = alive[np.ix_(asked, shown)] & (scores > self.floor[asked][:, None])
        for i in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[i])
            if len(at) > self.k:
                at = at[np.argsort(-scores[i, at], kind="stable")[: self.k]]
            query = asked[i]
            found = self.best[query] + [(int(scores[i, j]), int(ids[shown[j]])) for j in at]
            found.sort(key=lambda x: (-x[0], x[1]))
            self.best[query] = found[: self.k]
            if len(found) >= self.k:
                # Rounded down where a double can't hold it: then equals come in and are sorted out.
                floor = float(found[self.k - 1][0])
                self.floor[query] = floor if int(floor) <= found[self.k - 1][0] else np.nextafter(floor, -np.inf)


def _matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = part.column("vector").combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    flat = np.asarray(rows.flatten(), np.float64)
    return np.asarray(part.column("id")), flat.reshape(part.num_rows, -1 if len(flat) else 0)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, *, scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Both have vec_id and embedding; components become floor(scale * x). Returns query_id, rank (from
    1), vec_id and score; ties go to the smaller vec_id; fewer than ``k`` candidates are all returned.
    Rows with the query's vec_id are no candidates. A vector that is null or holds a null or non-finite
    component, or has a null vec_id, takes no part; vectors meet only others of their length. Repeated
    candidates count as often as they stand there; a repeated query is asked once, and queries that
    share a vec_id but not the vector each get their list. Scores beyond a long become its limit
    before they are compared; scaled components beyond 1e150 count as 1e150.
    """

    def valid(df: DataFrame) -> DataFrame:
        wide = F.col("embedding").cast("array<double>")
        rows = df.select(F.col("vec_id").cast("long").alias("id"), wide.alias("v"))
        rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(
            F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        )
        scaled = F.transform("v", lambda x: F.greatest(F.least(x * scale, F.lit(_WIDEST)), F.lit(-_WIDEST)))
        return rows.select("id", scaled.alias("vector"), F.size("v").alias("dim"), F.xxhash64("v").alias("key"))

    asked = valid(queries).dropDuplicates(["id", "vector"])
    shown = valid(vectors)
    n_queries, n_shown = asked.count(), shown.count()
    across, down = 1 + n_queries // QUERY_ROWS, 1 + n_shown // CANDIDATE_ROWS

    def cells(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "key"), F.lit(n_own)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select("*", mine).select("*", each)

    left = cells(asked, "q", across, "c", down)
    right = cells(shown, "c", down, "q", across)
    schema = "query_id long, query_key long, vec_id long, score long"

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, rows = _matrix(left)
            searcher = Searcher(ids, np.floor(rows), k)
            right = right.sort_by([("id", "ascending"), ("key", "ascending")])
            for start in range(0, right.num_rows, STEP):
                more, seen = _matrix(right.slice(start, STEP))
                searcher.add(more, np.floor(seen))
            for query, key, best in zip(ids, left.column("key").to_pylist(), searcher.best, strict=True):
                for score, vec in best:
                    for column, value in zip(out, (int(query), key, vec, score), strict=True):
                        column.append(value)
        names = ["query_id", "query_key", "vec_id", "score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out, strict=True)})

    by = ["dim", "q", "c"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(find, schema)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
