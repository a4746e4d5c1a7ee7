"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.session import staged


class Groups:
    """Union-find over any hashable items; the smallest item leads its group."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one batch as stars around the smallest node of each group."""
    for batch in batches:
        groups = Groups()
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            groups.join(a, b)
        pairs = [(x, groups.find(x)) for x in list(groups.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        if pairs:
            u, v = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (u, v: long).

    Each round joins all neighbours of a node to the smallest of them, larger neighbours first, then the
    smaller ones, until nothing changes. Minimums are taken before rows meet, so a node with a large part
    of all edges is no burden to one task; each round is written to the shared folder.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Read back as tables of their own, so that the joins can split the rows of a hub.
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        large = staged(large, "edges")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        edges = staged(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
