"""Jaccard join of documents on word shingles, by T-occurrence search.

Two sets with a Jaccard similarity of 0.9 differ in few shingles. If a hash deals the shingles of both
into more classes than they can differ in, some classes must agree whole; so sets that share no class
never need to meet. Each set sends a hash for every class (of its own size band and the next one). Sets that
share one are compared by their sizes and parity maps: each shingle flips one bit of a map, so two maps can't
differ in more bits than the sets do in shingles. What that bound leaves is gathered in clusters. Within a
cluster, every set searches an inverted index of shingles: the short lists of its shingles are merged with a
heap, which gives the sets that occur often enough to be candidates; the long lists are probed by binary
search, and a candidate is dropped as soon as it can't reach the overlap. A large cluster is cut into blocks,
every pair of which is one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes, parts
from tapeworks.llm.components import Groups, components
from tapeworks.llm.shingles import WordHashes, runs
from tapeworks.session import staged

SHINGLE = 3
#: Least similarity, in hundredths.
LEAST = 90
#: Text whose class hashes meet in one task; sets of one block; sets of small clusters in one task.
BUCKET_BYTES, BLOCK, BIN_SETS = 48 << 20, 1000, 2000
#: Sets that share a class hash: in one task; in one group, beyond which they are taken for alike.
TASK_SETS, CROWDED = 30_000, 4096
#: Bits of a parity map: so many times the shingles that may differ, within these bounds.
MAP_BITS, LEAST_BITS, MOST_BITS = 4, 64, 4096
NO_ID = -(2**63)
_PART_BYTES = 4 << 20
#: Classes beyond those that may differ, at least: as many empty ones need not be sent.
_SPARE = 2


def shingles(words: list[bytes], hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles in order; a shorter text is one shingle."""
    return np.unique(runs(hashes, min(size, len(words)))) if words else np.empty(0, np.uint64)


class Bands:
    """Size bands, and for each how many classes its sets are dealt into."""

    def __init__(self, least: int):
        self.least = least
        self.upto: list[int] = [0]

    def _grow(self, size: int) -> None:
        while self.upto[-1] < size:
            self.upto.append((self.upto[-1] + 1) * 100 // self.least)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.upto, size, "left"))

    def differ(self, band: int) -> int:
        while len(self.upto) <= band:
            self._grow(self.upto[-1] + 1)
        return 2 * self.upto[band] * (100 - self.least) // (100 + self.least)

    def spare(self, band: int) -> int:
        """As many classes as are likely to be empty: small sets of the band before have the most. A set
        that must send its empty ones meets all others that do."""
        share = (100 + self.least) / (2 * (100 - self.least)) * (self.least / 100) ** 2 if self.least < 100 else np.inf
        return _SPARE + int(1.6 * self.differ(band) * np.exp(-share))

    def classes(self, band: int) -> int:
        return self.differ(band) + 1 + self.spare(band)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def class_hashes(found: np.ndarray, bands: Bands) -> np.ndarray:
    """One hash for each class of a set, for its band and the next."""
    out = []
    own = bands.of(len(found))
    mixed = (found * _A) ^ (found >> np.uint64(29))
    for band in (own, own + 1):
        n = bands.classes(band)
        kind = ((found >> np.uint64(7)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        here, starts = np.unique(kind[order], return_index=True)
        sums = np.add.reduceat(mixed[order], starts)
        if n - len(here) > bands.spare(band):
            every = np.zeros(n, np.uint64)
            every[here] = sums
            here, sums = np.arange(n), every
        x = (sums + np.array([band], np.uint64) * _B) * _A + here.astype(np.uint64)
        x ^= x >> np.uint64(32)
        out.append(x * _B)
    return np.concatenate(out)


def parity_map(found: np.ndarray, bands: Bands) -> bytes:
    """Every shingle flips one bit; a power of two of them, so that maps of two lengths can be compared."""
    want, bits = MAP_BITS * bands.differ(bands.of(len(found)) + 1), LEAST_BITS
    while bits < min(want, MOST_BITS):
        bits *= 2
    odd = np.bincount(((found >> np.uint64(17)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class ParityMaps:
    """Parity maps of the sets of a group, folded to the shortest, for bounds on how much sets differ."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray, least: int):
        width = min(map(len, maps))
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in maps]
        self.maps, self.sizes, self.least = np.stack(folded).view(np.uint64), sizes, least

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """False where set ``i`` can't be similar enough."""
        apart = np.bitwise_count(self.maps[others] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
        total = self.sizes[others] + self.sizes[i]
        near = 100 * np.minimum(self.sizes[others], self.sizes[i]) >= self.least * np.maximum(self.sizes[others], self.sizes[i])
        return near & ((100 + self.least) * apart <= (100 - self.least) * total)

    def joined(self) -> list[tuple[int, int]]:
        """Pairs enough to join all sets that may belong together."""
        left, queue, out = np.arange(len(self.sizes)), [], []
        while len(left) + len(queue) > 1:
            if queue:
                at = queue.pop()
            else:
                at, left = int(left[0]), left[1:]
            if not len(left):
                break
            like = self.may_link(at, left)
            if like.any():
                new = left[like].tolist()
                out += [(at, x) for x in new]
                queue += new
                left = left[~like]
        return out


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _open(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


#: kind 0: a document, whose set has the 128-bit hash a1, a2; 1: a set (a1) with the class hash x that others
#: have too; 2: two sets (a1, a2) of a class hash that very many have.
_FACT = {"kind": pa.int32(), "doc_id": pa.int64(), "key_": pa.int64(), "n": pa.int64(),
         "a1": pa.int64(), "a2": pa.int64(), "x": pa.int64(), "map": pa.binary()}
_X_BYTES = 5


def sets_and_classes(docs: DataFrame, size: int, least: int, n_buckets: int) -> DataFrame:
    """Rows of documents with their sets, and rows of sets that share a class hash with another one."""
    names = ("bucket", "docs", "n", "x", "ids", "keys", "sizes", "sets", "of", "maps")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, bands = WordHashes(), Bands(least)
        for batch in (p for b in batches for p in parts(b, "text", _PART_BYTES)):
            known: dict[bytes, int] = {}
            own, sizes, classes, maps = [], [], [], []
            for text in as_bytes(batch.column("text")):
                words = (text or b"").lower().split()
                found = shingles(words, hashes_of.of(words), size)
                key = xxhash.xxh3_128_digest(found.tobytes())
                own.append(key)
                sizes.append(len(found))
                maps.append(parity_map(found, bands) if len(found) else b"")
                if len(found) and key not in known:
                    known[key] = len(known)
                    classes.append(class_hashes(found, bands))
            out: dict[str, list] = {k: [] for k in names}

            def add(*row, out=out) -> None:
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)

            ids, keys = np.asarray(batch.column("doc_id")), np.asarray(batch.column("key_"))
            lengths = np.array([len(x) for x in maps], np.int32)
            add(int(keys[0] % n_buckets), True, len(own), _packed(lengths), _packed(ids), _packed(keys),
                _packed(np.array(sizes)), _packed(np.frombuffer(b"".join(own), "<i8")), b"",
                zstandard.ZstdCompressor(level=1).compress(b"".join(maps)))
            if classes:
                x = np.concatenate(classes)
                of = np.repeat(np.arange(len(classes)), [len(c) for c in classes]).astype(np.int32)
                sets = np.frombuffer(b"".join(known), "<i8").reshape(-1, 2)[:, 0]
                bucket = (x >> np.uint64(11)) % np.uint64(n_buckets)
                order = np.lexsort((x, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[b] : cuts[b + 1]]
                    held, here = np.unique(of[mine], return_inverse=True)
                    short = x[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _X_BYTES :]
                    kind = np.uint16 if len(held) < 1 << 16 else np.int32
                    add(int(b), False, len(mine), _packed(short), b"", b"", b"", _packed(sets[held]),
                        _packed(here.astype(kind)), b"")
            kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(names))

    def settle(table: pa.Table) -> pa.Table:
        columns: dict[str, list] = {k: [] for k in _FACT}

        def give(rows: int, **given) -> None:
            none = np.zeros(rows, np.int64)
            for k in _FACT:
                columns[k].append(pa.array(given.get(k, [None] * rows if k == "map" else none), _FACT[k]))

        xs, sets = [], []
        for row in table.to_pylist():
            if row["docs"]:
                ends = np.cumsum(_open(row["x"], "<i4"))
                maps, own = zstandard.decompress(row["maps"]), _open(row["sets"], "<i8").reshape(-1, 2)
                give(row["n"], doc_id=_open(row["ids"], "<i8"), key_=_open(row["keys"], "<i8"), n=_open(row["sizes"], "<i8"),
                     a1=own[:, 0], a2=own[:, 1],
                     map=[maps[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
            else:
                x = np.zeros((row["n"], 8), np.uint8)
                x[:, 8 - _X_BYTES :] = _open(row["x"], np.uint8).reshape(-1, _X_BYTES)
                xs.append(x.view("<u8")[:, 0])
                mine = _open(row["sets"], "<i8")
                sets.append(mine[_open(row["of"], np.uint16 if len(mine) < 1 << 16 else np.int32)])
        if xs:
            x, own = np.concatenate(xs), np.concatenate(sets)
            order = np.lexsort((own, x))
            x, own = x[order], own[order]
            new = np.append(True, (x[1:] != x[:-1]) | (own[1:] != own[:-1]))
            x, own = x[new], own[new]
            starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            m = np.repeat(np.diff(np.append(starts, len(x))), np.diff(np.append(starts, len(x))))
            first = np.repeat(own[starts], np.diff(np.append(starts, len(x))))
            # The same pair met in several classes is told once.
            two, many = m == 2, (m > 2) & (m <= CROWDED)
            lead = np.flatnonzero(two & (first == own))
            pairs = np.unique(np.stack([own[lead], own[lead + 1]], axis=1), axis=0) if len(lead) else np.empty((0, 2), np.int64)
            named = np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in pairs], np.uint64)
            some = np.concatenate([x[many] * _A, np.repeat(named, 2)]).view(np.int64)
            give(len(some), kind=np.ones(len(some), np.int32), x=some, a1=np.concatenate([own[many], pairs.reshape(-1)]))
            crowd = (m > CROWDED) & (first != own)
            stars = np.unique(np.stack([first[crowd], own[crowd]], axis=1), axis=0)
            give(len(stars), kind=np.full(len(stars), 2, np.int32), a1=stars[:, 0], a2=stars[:, 1])
        return pa.table({k: pa.chunked_array(v, _FACT[k]) for k, v in columns.items()})

    sent = ", ".join(f"{k} binary" for k in names[3:])
    facts = "kind int, " + ", ".join(f"{k} long" for k in list(_FACT)[1:-1]) + ", map binary"
    return docs.mapInArrow(send, f"bucket int, docs boolean, n int, {sent}").groupBy("bucket").applyInArrow(settle, facts)


def candidates(shared: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """u, v: nodes of sets that share a class hash and may be similar enough, enough pairs to join all those."""

    def bound(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("x"))
        order = np.lexsort((np.asarray(table.column("node")), x))
        x, nodes, sizes = x[order], np.asarray(table.column("node"))[order], np.asarray(table.column("n"))[order]
        maps = as_bytes(table.column("map").combine_chunks())
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
        out: set[tuple[int, int]] = set()
        for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
            if b - a > 1:
                group = ParityMaps([maps[i] for i in order[a:b].tolist()], sizes[a:b], least)
                out.update((int(nodes[a + i]), int(nodes[a + j])) for i, j in group.joined())
        u, v = zip(*sorted(out), strict=True) if out else ([], [])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    n_bins = 1 + shared.filter("kind = 1").count() // TASK_SETS
    # The same group, or pair, met in several buckets is told once.
    told = shared.filter("kind = 1").select("x", "a1").distinct()
    named = told.join(reps.select("a1", "node", "n", "map"), "a1").withColumn("bin", F.pmod(F.xxhash64("x"), F.lit(n_bins)))
    met = named.select("bin", "x", "node", "n", "map").groupBy("bin").applyInArrow(bound, "u long, v long")
    ends = shared.filter("kind = 2").select("a1", F.col("a2").alias("b1")).distinct()
    ends = ends.join(reps.select("a1", F.col("node").alias("u")), "a1")
    ends = ends.join(reps.select(F.col("a1").alias("b1"), F.col("node").alias("v")), "b1")
    return met.unionByName(ends.select("u", "v")).distinct()


class Index:
    """Inverted lists over the sets of one block, searched as DivideSkip does."""

    def __init__(self, sets: list[np.ndarray], least: int):
        self.least = least
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.owners = owners[order]
        self.starts = np.append(starts, len(tokens))

    def lists(self, found: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.tokens, found)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == found)]
        return [self.owners[self.starts[i] : self.starts[i + 1]] for i in at]

    def search(self, found: np.ndarray, skip: np.ndarray) -> Iterator[int]:
        """Sets similar enough, but for those that ``skip`` marks (it may change meanwhile)."""
        size = len(found)
        need = -(-self.least * size // 100)
        lists = sorted(self.lists(found), key=len)
        if len(lists) < need:
            return
        # Long lists: all but so many that a set in none of the short ones can't reach the overlap.
        n_long = min(need - 1, int(need / (0.001 * np.log2(len(lists[-1]) + 1) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        count: list[tuple[int, int]] = []
        merged = heapq.merge(*[x.tolist() for x in short])
        for owner, same in groupby(merged):
            n = sum(1 for _ in same)
            if n >= need - n_long and not skip[owner]:
                count.append((owner, n))
        if not count:
            return
        who, n = (np.array(x) for x in zip(*count, strict=True))
        # The overlap that each candidate needs, by its size as well.
        both = self.sizes[who] + size
        least = -(-self.least * both // (100 + self.least))
        left = len(long_)
        for x in long_:
            alive = n + left >= least
            if not alive.all():
                who, n, least = who[alive], n[alive], least[alive]
                if not len(who):
                    return
            at = np.searchsorted(x, who)
            n = n + (x[np.minimum(at, len(x) - 1)] == who)
            left -= 1
        for i in who[n >= least].tolist():
            if not skip[i]:
                yield i


def _links(ids: list[int], sets: list[np.ndarray], asks: list[bool], gives: list[bool], least: int) -> list[tuple]:
    """Links enough to join all sets that belong together: from ``asks`` to ``gives``."""
    shown = [i for i, x in enumerate(gives) if x]
    if not shown or not any(asks):
        return []
    index, groups, out = Index([sets[i] for i in shown], least), Groups(), []
    tops = np.array([ids[i] for i in shown])
    for i, x in enumerate(asks):
        if not x:
            continue
        mine = groups.find(ids[i])
        skip = tops == mine
        for at in index.search(sets[i], skip):
            mine, other = groups.find(ids[i]), groups.find(int(tops[at]))
            if groups.join(mine, other):
                out.append((ids[i], ids[shown[at]]))
            top = groups.find(mine)
            tops[(tops == mine) | (tops == other)] = top
            skip |= tops == top
    return out


def search_clusters(docs: DataFrame, clusters: DataFrame, size: int, least: int) -> DataFrame:
    """u, v: links between the sets of each cluster. ``clusters``: node, doc_id, key_, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    n_bins = 1 + clusters.count() // BIN_SETS
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = clusters.join(sizes, "cluster").withColumn("blocks", blocks)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Small clusters share tasks; a large one has a task for each pair of its blocks.
    bins = F.pmod(F.xxhash64("cluster"), F.lit(n_bins)).cast("long")
    placed = placed.select("node", "doc_id", "key_", "cluster", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select(
        "node", "doc_id", "key_", "cluster", "own",
        F.struct(
            F.when(F.col("blocks") == 1, bins).otherwise(F.col("cluster")).alias("where"),
            F.col("blocks") > 1, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        ).alias("task"),
    )
    schema = "task string, cluster long, node long, own int, i int, j int, found binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in batches:
            made = []
            for text in as_bytes(batch.column("text")):
                words = (text or b"").lower().split()
                made.append(shingles(words, hashes_of.of(words), size).tobytes())
            columns = [batch.column(k) for k in ("task", "cluster", "node", "own", "i", "j")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(made, pa.binary())], ["task", "cluster", "node", "own", "i", "j", "found"]
            )

    def join(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        rows = [table.column(k).to_pylist() for k in ("cluster", "node", "own", "i", "j", "found")]
        for _, group in groupby(zip(*rows, strict=True), key=lambda r: r[0]):
            group = list(group)
            sets = [np.frombuffer(r[5], np.uint64) for r in group]
            same = group[0][3] == group[0][4]
            asks = [same or r[2] == r[4] for r in group]
            gives = [same or r[2] == r[3] for r in group]
            out += _links([r[1] for r in group], sets, asks, gives, least)
        u, v = zip(*out, strict=True) if out else ([], [])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return (
        # Text is shuffled at every size, so that work grows as the input does.
        docs.join(placed.hint("merge"), ["doc_id", "key_"])
        .select(
            "text", F.to_json("task").alias("task"), "cluster", "node", "own",
            F.col("task.i").alias("i"), F.col("task.j").alias("j"),
        )
        .mapInArrow(make, schema)
        .groupBy("task")
        .applyInArrow(join, "u long, v long")
    )


def jaccard_groups(docs: DataFrame, *, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Documents joined by links of a Jaccard similarity of ``least`` hundredths or more.

    A document's set: its distinct runs of ``size`` words (runs of characters that are not ASCII white
    space, A-Z in lower case), or the whole text as one if it has fewer. Returns doc_id, key_ (a hash of
    the text), n_shingles and component_id, the smallest doc_id reachable by links. Documents without
    words are linked with nothing. A null doc_id comes before all others. Repeated rows and rows that
    share a doc_id are documents of their own with the same id. No rows give none; other columns are not
    read. Shingles are told apart by 63 bits of hash, whole sets by 128.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("key_"),
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The lower the threshold, the more class hashes for the same text (1 at 90 hundredths).
    weight = max(1, 19 * (100 - least) / (100 + least))
    facts = staged(sets_and_classes(rows, size, least, 1 + int(n_bytes * weight) // BUCKET_BYTES), "sets")
    members = facts.filter("kind = 0").select("doc_id", "key_", "n", "a1", "a2", "map")
    # One document stands for all with the same set; sets have numbers of their own, as ids may be shared.
    reps = members.filter("n > 0").groupBy("a1", "a2").agg(F.min(F.struct("doc_id", "key_", "n", "map")).alias("rep"))
    reps = staged(reps.select("a1", "a2", "rep.*").withColumn("node", F.monotonically_increasing_id()), "reps")
    clusters = components(staged(candidates(facts, reps, least), "ends"))
    clusters = staged(reps.select("node", "doc_id", "key_").join(clusters.withColumnRenamed("component", "cluster"), "node"), "clusters")
    linked = components(staged(search_clusters(rows, clusters, size, least), "links"))
    named = reps.select("a1", "a2", "node", "doc_id").join(linked, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("first"))
    named = staged(named.join(firsts, "component").select("a1", "a2", "first"), "named")
    return members.drop("map").join(named, ["a1", "a2"], "left").select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "key_", F.col("n").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")), F.lit(NO_ID)).alias("component_id"),
    )
