"""MinHash near-duplicate groups with an LSH forest, confirmed on full sets.

Each distinct shingle set gets a MinHash signature. A tree is one order of the signature's components; in it,
sets that agree in the first few components stand side by side. Depth adapts to the region: where a prefix is
shared by few sets, it is a region; where by many, those sets are parted by longer prefixes, and only they.
Within a region, sets sorted by signature are searched from neighbour to neighbour; those whose whole
signatures agree well enough are candidates. A region too large at the last depth is taken whole. Sets of a
crowded region that longer prefixes part are compared too: it is cut into chunks, and every two chunks are
searched together.

Candidates only say which sets may belong together: their closure is a cluster, wider than the answer. In a
cluster, links are decided on the full sets. A large cluster is cut into blocks: links inside each block first;
then the best linked sets of every block against all blocks; what is still outside the cluster's largest
group after that is held against the whole cluster, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes, parts, text_key
from tapeworks.llm.components import Groups, components
from tapeworks.llm.shingles import WordHashes, runs
from tapeworks.session import staged

SHINGLE = 5
#: Least similarity, in hundredths.
LEAST = 80
#: Components of a signature; trees, each starting so many components after the one before.
COMPONENTS, TREES, STRIDE = 128, 32, 4
#: Lengths of prefixes, and the number of sets above which a region goes on to the next length.
DEPTHS, CROWDED = (5, 8, 12, 20), 4096
#: Standard errors by which an estimate may fall short of the least similarity.
SLACK = 5
#: Rows of one task of regions; shingles of one block, and of one task of small clusters.
TASK_ROWS, BLOCK, TASK = 20_000, 600_000, 1_000_000
#: Sets of a block that are held against the whole cluster first.
PIVOTS = 3
NO_ID = -(2**63)
_PART_BYTES, _STEP = 4 << 20, 8192

_rng = np.random.default_rng(20240917)
_A = _rng.integers(0, 2**32, COMPONENTS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, COMPONENTS, dtype=np.uint32)


def shingle_set(text: bytes, hashes_of: WordHashes, size: int) -> np.ndarray:
    """Distinct shingles in order; a shorter text is one shingle."""
    words = text.lower().split()
    return np.unique(runs(hashes_of.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each component of a set's MinHash."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(COMPONENTS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), _STEP):
        np.minimum(out, (np.multiply.outer(_A, low[at : at + _STEP]) + _B[:, None]).min(axis=1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key_, n, a1, a2 (the set's 128-bit hash), signature (null without shingles)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in (p for b in batches for p in parts(b, "text", _PART_BYTES)):
            known: dict[bytes, bytes] = {}
            keys, sizes, marks = [], [], []
            for text in as_bytes(batch.column("text")):
                found = shingle_set(text or b"", hashes_of, size)
                key = xxhash.xxh3_128_digest(found.tobytes())
                if len(found) and key not in known:
                    known[key] = signature(found).tobytes()
                keys.append(key)
                sizes.append(len(found))
                marks.append(known.get(key))
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key_"), pa.array(sizes, pa.int64()),
                 pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(marks, pa.binary())],
                ["doc_id", "key_", "n", "a1", "a2", "signature"],
            )

    return docs.mapInArrow(make, "doc_id long, key_ long, n long, a1 long, a2 long, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(as_bytes(column)), "<u2").reshape(-1, COMPONENTS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each row of 16-bit numbers."""
    out = np.full(x.shape[:-1], x.shape[-1], np.uint64)
    for i in range(x.shape[-1]):
        out = (out ^ x[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def prefixes(sets: DataFrame, depth: int, trees: bool) -> DataFrame:
    """node, tree and key (of the tree's prefix) for the signatures of ``sets``; for all trees, or the row's."""
    orders = (np.arange(TREES)[:, None] * STRIDE + np.arange(depth)) % COMPONENTS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks, nodes = _signatures(batch.column("signature")), np.asarray(batch.column("node"))
            if trees:
                tree, nodes = np.tile(np.arange(TREES), len(nodes)), np.repeat(nodes, TREES)
                heads = marks[:, orders].reshape(-1, depth)
            else:
                tree = np.asarray(batch.column("tree")).astype(np.int64)
                heads = marks[np.arange(len(marks))[:, None], orders[tree]]
            key = _mixed(heads) + tree.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(tree.astype(np.int32)), pa.array(key.view(np.int64))],
                ["node", "tree", "key"],
            )

    columns = ["node", "signature"] if trees else ["node", "tree", "signature"]
    return sets.select(*columns).mapInArrow(make, "node long, tree int, key long")


def _walk(marks: np.ndarray, need: int) -> list[tuple[int, int]]:
    """From each set to all like it that no other has reached yet."""
    left, out = np.arange(1, len(marks)), []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        like = (marks[left] == marks[at]).sum(axis=1) >= need
        if like.any():
            new = left[like].tolist()
            out += [(at, x) for x in new]
            queue += new[::-1]
            left = left[~like]
    return out


def likely(regions: DataFrame, sets: DataFrame, need: int, n_bins: int) -> DataFrame:
    """u, v: candidates within each region of ``regions`` (node, tree, key), enough of them to join all."""

    def search(table: pa.Table) -> pa.Table:
        marks, nodes = _signatures(table.column("signature")), np.asarray(table.column("node"))
        keys, trees = np.asarray(table.column("key")), np.asarray(table.column("tree"))
        # In the order of the tree, so that a set's neighbours are those with the longest common prefix.
        turn = (np.arange(8) + trees[:, None] * STRIDE) % COMPONENTS
        heads = marks[np.arange(len(marks))[:, None], turn].astype(">u2").view(">u8")
        order = np.lexsort((heads[:, 1], heads[:, 0], keys))
        marks, nodes, keys = marks[order], nodes[order], keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[(marks[two] == marks[two + 1]).sum(axis=1) >= need]
        pairs = [np.stack([nodes[two], nodes[two + 1]], axis=1)]
        for at, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = _walk(marks[at : at + m], need)
            if found:
                pairs.append(nodes[at + np.array(found)])
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.table({"u": pa.array(both[:, 0], pa.int64()), "v": pa.array(both[:, 1], pa.int64())})

    rows = regions.join(sets.select("node", "signature"), "node")
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(n_bins)))
    return rows.groupBy("bin").applyInArrow(search, "u long, v long")


def across(crowd: DataFrame, sets: DataFrame, need: int) -> DataFrame:
    """u, v: candidates within each region of ``crowd`` (node, key, m sets in all), enough of them to join all,
    whatever longer prefixes part. Every two chunks of a region are one group."""

    def search(table: pa.Table) -> pa.Table:
        marks, nodes = _signatures(table.column("signature")), np.asarray(table.column("node"))
        both = nodes[np.array(_walk(marks, need), np.int64).reshape(-1, 2)]
        return pa.table({"u": pa.array(both[:, 0], pa.int64()), "v": pa.array(both[:, 1], pa.int64())})

    # A region is crowded, so it has two chunks at least.
    chunks = F.ceil(F.col("m") / F.lit(CROWDED)).cast("int")
    rows = crowd.select("node", "key", chunks.alias("chunks")).join(sets.select("node", "signature"), "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("mine <> other")
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    rows = rows.select("key", "low", "high", "node", "signature")
    return rows.groupBy("key", "low", "high").applyInArrow(search, "u long, v long")


def forest(sets: DataFrame, least: int) -> DataFrame:
    """u, v (staged): candidate pairs of ``sets`` (node, signature), enough to join all that are alike."""
    p = least / 100
    need = int(np.floor(COMPONENTS * p - SLACK * np.sqrt(COMPONENTS * p * (1 - p))))
    found, rows = [], prefixes(sets, DEPTHS[0], True)
    for i, depth in enumerate(DEPTHS):
        # Read back as a table of its own, so that the join can split the rows of a crowded prefix.
        held = staged(
            rows.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lead")).filter("m > 1"), "prefixes"
        )
        total, most = held.agg(F.sum(F.when(F.col("m") <= CROWDED, F.col("m"))), F.max("m")).first()
        met = rows.join(held, "key")
        if total:
            few = met.filter(F.col("m") <= CROWDED)
            found.append(staged(likely(few, sets, need, 1 + total // TASK_ROWS).distinct(), "likely"))
        if not most or most <= CROWDED:
            break
        crowd = staged(met.filter(F.col("m") > CROWDED).select("node", "tree", "lead", "key", "m"), "crowd")
        if i == 0:
            found.append(staged(across(crowd, sets, need).distinct(), "across"))
        if i + 1 == len(DEPTHS):
            # Alike as far as the forest can tell: the full sets decide.
            found.append(crowd.filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")))
        else:
            rows = prefixes(crowd.join(sets.select("node", "signature"), "node"), DEPTHS[i + 1], False)
    if not found:
        return sets.limit(0).select(F.col("node").alias("u"), F.col("node").alias("v"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


class Sets:
    """Sets of one task, for overlaps of one with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.tokens, self.of = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]

    def like(self, found: np.ndarray, least: int) -> np.ndarray:
        """Which sets are similar enough to ``found``."""
        at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
        known = np.zeros(len(self.tokens), np.int64)
        known[at[self.tokens[at] == found]] = 1
        both = np.add.reduceat(known[self.of], self.starts)
        return 100 * both >= least * (len(found) + self.sizes - both)

    def only(self, keep: np.ndarray) -> "Sets":
        out = object.__new__(Sets)
        out.tokens, out.sizes = self.tokens, self.sizes[keep]
        out.of = self.of[np.repeat(keep, self.sizes)]
        out.starts = np.append(0, np.cumsum(out.sizes))[:-1]
        return out


def inner_links(sets: list[np.ndarray], least: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links enough to join all sets that belong together, and the sets that reached most others."""
    out, reach, queue = [], {}, []
    left, index = np.arange(len(sets)), Sets(sets)
    while len(left) + len(queue) > 1:
        if queue:
            at = queue.pop()
        else:
            at, keep = int(left[0]), np.arange(len(left)) > 0
            left, index = left[keep], index.only(keep)
        if not len(left):
            break
        linked = index.like(sets[at], least)
        if linked.any():
            new = left[linked].tolist()
            out += [(at, x) for x in new]
            reach[at] = len(new)
            queue += new
            left, index = left[~linked], index.only(~linked)
    return out, sorted(reach, key=reach.get, reverse=True)[:PIVOTS]


class _Task:
    """Rows of one task, with their sets; rows of one node are one."""

    def __init__(self, table: pa.Table, size: int, hashes_of: WordHashes):
        texts, nodes = as_bytes(table.column("text").combine_chunks()), table.column("node").to_pylist()
        clusters = table.column("cluster").to_pylist()
        self.clusters: dict[int, dict[int, np.ndarray]] = {}
        for text, node, cluster in zip(texts, nodes, clusters, strict=True):
            mine = self.clusters.setdefault(cluster, {})
            if node not in mine:
                mine[node] = shingle_set(text or b"", hashes_of, size)


_LINKS = "cluster long, u long, v long"


def _links(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("cluster", "u", "v"), columns, strict=True)})


def block_links(texts: DataFrame, size: int, least: int) -> DataFrame:
    """cluster, u, v: links within each block; rows without v name the block's best linked sets."""

    def settle(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        big = table.column("big")[0].as_py()
        for cluster, held in _Task(table, size, WordHashes()).clusters.items():
            nodes = sorted(held)
            pairs, best = inner_links([held[x] for x in nodes], least)
            rows += [(cluster, nodes[a], nodes[b]) for a, b in pairs]
            if big:
                rows += [(cluster, nodes[a], None) for a in best]
        return _links(rows)

    return texts.groupBy("big", "place", "block").applyInArrow(settle, _LINKS)


def cross_links(texts: DataFrame, asks: DataFrame, size: int, least: int) -> DataFrame:
    """cluster, u, v: links of ``asks`` (cluster, node) with all sets of their clusters, enough to join them."""
    own = texts.filter("big").join(asks, ["cluster", "node"]).drop("block", "place")
    counts = texts.filter("big").select("cluster", "node", "n").join(asks, ["cluster", "node"])
    counts = staged(counts.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("asked")), "asked")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = own.join(counts, "cluster").select(
        "cluster", upto("blocks").alias("block"), F.pmod(F.xxhash64("node"), "asked").cast("int").alias("turn"),
        "node", "text", F.lit(True).alias("ask"),
    )
    asked = texts.filter("big").join(counts, "cluster").select(
        "cluster", "block", upto("asked").alias("turn"), "node", "text", F.lit(False).alias("ask")
    )

    def settle(table: pa.Table) -> pa.Table:
        ask, hashes_of = table.column("ask"), WordHashes()
        cluster = table.column("cluster")[0].as_py()
        (mine,) = _Task(table.filter(ask), size, hashes_of).clusters.values() or ({},)
        (other,) = _Task(table.filter(pc.invert(ask)), size, hashes_of).clusters.values() or ({},)
        rows: list[tuple] = []
        if mine and other:
            groups, nodes = Groups(), np.array(sorted(other))
            index = Sets([other[x] for x in nodes.tolist()])
            for node in sorted(mine):
                for x in nodes[index.like(mine[node], least)].tolist():
                    if groups.join(node, x):
                        rows.append((cluster, node, x))
        return _links(rows)

    return asking.unionByName(asked).groupBy("cluster", "block", "turn").applyInArrow(settle, _LINKS)


def confirmed(docs: DataFrame, reps: DataFrame, clusters: DataFrame, size: int, least: int) -> DataFrame:
    """u, v: links between the sets of each of ``clusters`` (node, cluster), enough to join what belongs together."""
    members = staged(clusters.join(reps.select("node", "doc_id", "key_", "n"), "node"), "members")
    sizes = staged(members.groupBy("cluster").agg(F.sum("n").alias("total")), "totals")
    total, most = sizes.agg(F.sum("total"), F.max("total")).first()
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    n_bins = 1 + (total or 0) // TASK
    placed = members.join(sizes, "cluster").withColumn("blocks", blocks).withColumn("big", blocks > 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    where = F.when(F.col("big"), F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(n_bins)))
    texts = docs.select("doc_id", "key_", "text").join(placed.withColumn("place", where), ["doc_id", "key_"])
    texts = texts.select("big", "place", "block", "blocks", "cluster", "node", "n", "text")
    if (most or 0) <= BLOCK:
        return staged(block_links(texts, size, least).select("u", "v"), "links")
    texts = staged(texts.dropDuplicates(["node"]), "texts")
    first = staged(block_links(texts, size, least), "links")
    best = first.filter("v IS NULL").select("cluster", F.col("u").alias("node"))
    links = first.filter("v IS NOT NULL")
    links = staged(links.unionByName(cross_links(texts, best, size, least)).select("u", "v"), "links")
    joined = components(links)
    mine = texts.filter("big").select("cluster", "node").join(joined, "node", "left")
    mine = staged(mine.withColumn("component", F.coalesce("component", "node")), "joined")
    counts = mine.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    largest = staged(counts.groupBy("cluster").agg(F.max_by("component", "m").alias("largest")), "largest")
    rest = mine.join(largest, "cluster").filter("component <> largest").select("cluster", "node")
    return staged(links.unionByName(cross_links(texts, staged(rest, "rest"), size, least).select("u", "v")), "links")


def near_groups(docs: DataFrame, *, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Documents joined by links of a Jaccard similarity of ``least`` hundredths or more, candidates by MinHash.

    A document's set: its distinct runs of ``size`` words (runs of characters that are not ASCII white space,
    A-Z in lower case), or the whole text as one if it has fewer. Returns doc_id, key_ (a hash of the text),
    n_shingles, component_id (the smallest doc_id reachable by links) and kept (the two are equal).

    Documents without words are linked with nothing and kept. A null doc_id comes before all others. Repeated
    rows and rows that share a doc_id are documents of their own with the same id. No rows give none; other
    columns are not read. Shingles are told apart by 63 bits of hash, whole sets by 128. A pair of similarity
    0.8 is missed by every tree about once in 300,000 times, and by the estimate about as often; what links
    others of its group joins it even then. For a ``least`` under 80 trees should be added.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text",
        text_key().alias("key_"),
    )
    facts = staged(describe(rows, size), "facts")
    # One document stands for all with the same set; numbers of its own, as ids may be shared.
    reps = facts.filter("n > 0").groupBy("a1", "a2").agg(
        F.min(F.struct("doc_id", "key_", "n", "signature")).alias("rep")
    )
    reps = staged(reps.select("a1", "a2", "rep.*").withColumn("node", F.monotonically_increasing_id()), "reps")
    clusters = components(forest(reps, least)).select("node", F.col("component").alias("cluster"))
    joined = components(confirmed(rows, reps, clusters, size, least))
    named = reps.select("a1", "a2", "node", "doc_id").join(joined, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(named.join(firsts, "component").select("a1", "a2", "component_id"), "named")
    own = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    found = facts.drop("signature").join(named, ["a1", "a2"], "left").withColumn("component_id", own)
    return found.select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "key_", F.col("n").alias("n_shingles"),
        F.expr(f"nullif(component_id, {NO_ID})").alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )
