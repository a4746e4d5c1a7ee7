"""Removal of repeated passages, by suffix automata of reference shards.

The reference of a corpus is what it says first: for every passage met again, the place where it stands
first. It is found by anchors. A window of 20 words picks the run of a few words with the smallest hash
inside it, so equal windows pick equal runs; runs that only one place has never move again. For the
others the first place becomes reference text, dealt into shards of bounded size, and each later place
names the shard it must be held against. A task builds the automaton of one shard and streams the spans
sent to it: matching statistics give, word by word, the longest stretch that the shard also has, and an
earlier place of each window long enough. A shard asked for by many spans is sent to many tasks.

Windows that the first place of their anchor does not settle (the words around it differ there) are few;
they go through the same steps once more with the whole window as anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes, parts
from tapeworks.llm.shingles import WordHashes, runs, sliding
from tapeworks.session import staged

WINDOW, ANCHOR = 20, 6
#: Bytes of text whose anchors meet in one task; bytes that one reference shard can hold at most;
#: anchors held against one copy of a shard.
BUCKET_BYTES, SHARD_BYTES, ASKED = 24 << 20, 6 << 20, 50_000
_PART_BYTES = 4 << 20
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(2**63)
_CHUNK = 1 << 15


def anchors(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows; ``ends``: where each piece ends."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = runs(hashes, gram)
    width = window - gram + 1
    least = sliding(x, width, np.minimum)
    at = np.arange(n)
    least = np.where(ends[np.searchsorted(ends, at, "right")] >= at + window, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    found = np.flatnonzero(most == x)
    return found, x[found]


class Automaton:
    """Suffix automaton over words, with the first end of every state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def add(self, words: list[int]) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        last, at = self.last, self.size
        for w in words:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            first.append(at)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and nexts[p].get(w) == q:
                        nexts[p][w] = copy
                        p = link[p]
            last, at = now, at + 1
        self.last, self.size = last, at

    def cut(self) -> None:
        """What comes next does not continue what came before."""
        self.last = 0

    def matches(self, words: list[int | None], window: int) -> Iterator[tuple[int, int]]:
        """Each window start whose words the automaton has, and the first end of them there."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        state = held = 0
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                held = length[state]
            to = nexts[state].get(w)
            if to is None:
                continue
            state, held = to, held + 1
            if held >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                yield i - window + 1, first[at]


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _open(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


_ROUTE = "doc_id long, key_ long, pos int, ref_id long, ref_key long, ref_pos int, spread boolean"
_ROUTE_NAMES = ["doc_id", "key_", "pos", "ref_id", "ref_key", "ref_pos", "spread"]
#: An anchor with more places than this in one batch is settled against the first of them.
_MANY = 4


_PIECES = "array<struct<first:int,text:binary>>"
_RANGES = "array<struct<first:int,last:int>>"
_PIECE = pa.list_(pa.struct([("first", pa.int32()), ("text", pa.binary())]))
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each piece: doc_id, key_, first, text."""
    pieces = batch.column("pieces")
    of, values = pc.list_parent_indices(pieces), pieces.flatten()
    columns = [batch.column("doc_id").take(of), batch.column("key_").take(of), *values.flatten()]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "key_", "first", "text"])


_SENT = ("bucket", "settled", "n", "h", "ids", "keys", "pos", "doc", "hot")


def routes(pieces: DataFrame, window: int, gram: int, n_buckets: int) -> DataFrame:
    """For each anchor met before, where it stands and where it stood first.

    Equal anchors inside one batch are settled there if they are many, so a passage that a large part of
    all documents share sends a few entries a batch; anchors travel packed, a row for a batch and bucket.
    ``spread`` marks a first place that some batch did not hold its anchors against; what stands there is
    asked once more with the windows left over.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in (p for b in batches for p in parts(_flat(b), "text", _PART_BYTES)):
            batch = batch.take(pc.sort_indices(pa.table(batch), [("doc_id", "ascending"), ("first", "ascending")]))
            hashes = [hashes_of.of((x or b"").split()) for x in as_bytes(batch.column("text"))]
            ends = np.cumsum([len(x) for x in hashes])
            found, values = anchors(np.concatenate(hashes), ends, window, gram)
            if not len(found):
                continue
            piece = np.searchsorted(ends, found, "right")
            begin = ends - [len(x) for x in hashes]
            pos = (found - begin[piece] + np.asarray(batch.column("first"))[piece]).astype(np.int32)
            ids, keys = np.asarray(batch.column("doc_id")), np.asarray(batch.column("key_"))
            _, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
            hot = counts[inverse] > _MANY
            many = hot & (first[inverse] != np.arange(len(values)))
            if many.any():
                at, ref = np.flatnonzero(many), first[inverse[many]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([int(values[at[0]] % np.uint64(n_buckets))], pa.int32()),
                        "settled": [True], "n": pa.array([len(at)], pa.int32()),
                        "h": [b""], "ids": [_packed(np.stack([ids[piece[at]], ids[piece[ref]]]))],
                        "keys": [_packed(np.stack([keys[piece[at]], keys[piece[ref]]]))],
                        "pos": [_packed(np.stack([pos[at], pos[ref]]))], "doc": [b""], "hot": [b""],
                    }
                )
            rest = np.flatnonzero(~many)
            rest = rest[np.argsort(values[rest], kind="stable")]
            bucket = (values[rest] >> np.uint64(1)) % np.uint64(n_buckets)
            rest = rest[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(n_buckets + 1))
            out: dict[str, list] = {k: [] for k in _SENT}
            for b in np.flatnonzero(np.diff(cuts)):
                mine = rest[cuts[b] : cuts[b + 1]]
                held, doc = np.unique(piece[mine], return_inverse=True)
                row = (int(b), False, len(mine), _packed(values[mine]), _packed(ids[held]), _packed(keys[held]),
                       _packed(pos[mine]), _packed(doc.astype(np.int32)), _packed(hot[mine]))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def settle(table: pa.Table) -> pa.Table:
        done, held = [], []
        for row in table.to_pylist():
            ids, keys = _open(row["ids"], "<i8"), _open(row["keys"], "<i8")
            pos = _open(row["pos"], "<i4")
            if row["settled"]:
                n = row["n"]
                done.append((ids[:n], keys[:n], pos[:n], ids[n:], keys[n:], pos[n:], np.zeros(n, bool)))
            else:
                doc = _open(row["doc"], "<i4")
                held.append((_open(row["h"], "<u8"), ids[doc], keys[doc], pos, _open(row["hot"], "?")))
        if held:
            h, ids, keys, pos, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((pos, ids, h))
            h, ids, keys, pos, hot = h[order], ids[order], keys[order], pos[order], hot[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            spread = np.bincount(group, hot)[group] > 0
            later = (ids != ids[first]) | (pos != pos[first])
            at, ref = np.flatnonzero(later), first[later]
            done.append((ids[at], keys[at], pos[at], ids[ref], keys[ref], pos[ref], spread[at]))
        columns = [np.concatenate(x) for x in zip(*done, strict=True)]
        return pa.table(dict(zip(_ROUTE_NAMES, columns, strict=True)))

    schema = "bucket int, settled boolean, n int, " + ", ".join(f"{k} binary" for k in _SENT[3:])
    return pieces.mapInArrow(send, schema).groupBy("bucket").applyInArrow(settle, _ROUTE)


def spans(pieces: DataFrame, found: DataFrame, window: int, gram: int, n_shards: int) -> DataFrame:
    """Reference and asking text: shard, copy, kind (0 and 1: reference, 1 also goes on; 2: asks), doc_id,
    key_, start, text."""
    shard = F.pmod(F.xxhash64("ref_id", F.expr(f"ref_pos div {_CHUNK}")), F.lit(n_shards)).cast("int")
    found = found.withColumn("shard", shard)
    copies = found.groupBy("shard").agg((F.count("*") / ASKED + 1).cast("int").alias("copies"))
    found = found.join(copies, "shard")
    mine = F.pmod(F.xxhash64("doc_id", "key_"), F.col("copies")).cast("int")
    asks = found.select("doc_id", "key_", F.struct(F.lit(2).alias("kind"), "shard", mine.alias("copy"), "pos").alias("need"))
    gives = (
        found.groupBy("ref_id", "ref_key", "ref_pos", "shard", "copies")
        .agg(F.max(F.col("spread").cast("int")).alias("spread"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        .select(
            F.col("ref_id").alias("doc_id"), F.col("ref_key").alias("key_"),
            F.struct(
                F.when(F.col("copy") == 0, F.col("spread")).otherwise(0).alias("kind"), "shard", "copy",
                F.col("ref_pos").alias("pos"),
            ).alias("need"),
        )
    )
    needs = asks.unionByName(gives).groupBy("doc_id", "key_").agg(F.collect_set("need").alias("needs"))
    width = window - gram + 1
    schema = "shard int, copy int, kind int, doc_id long, key_ long, start int, text binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key_").to_pylist()
            needs_, of = batch.column("needs"), pc.list_parent_indices(batch.column("pieces")).to_pylist()
            pieces_ = zip(of, batch.column("pieces").flatten().to_pylist(), strict=True)
            for i, piece in pieces_:
                words, begin = piece["text"].split(), piece["first"]
                x = needs_[i].values
                fields = [np.asarray(x.field(k)) for k in ("shard", "copy", "kind", "pos")]
                inside = (fields[3] >= begin) & (fields[3] + gram <= begin + len(words))
                fields = [f[inside] for f in fields]
                order = np.lexsort((fields[3], fields[2], fields[1], fields[0]))
                last, upto = None, -1
                for s, c, a, p in zip(*(f[order].tolist() for f in fields), strict=True):
                    lo = max(0, p - begin - width + 1)
                    hi = min(len(words), p - begin + window)
                    if (s, c, a) == last and lo <= upto:
                        out[-1][6], upto = hi, hi
                    else:
                        out.append([s, c, a, ids[i], keys[i], lo, hi, words, begin])
                        last, upto = (s, c, a), hi
            rows = [(*x[:5], x[5] + x[8], b" ".join(x[7][x[5] : x[6]])) for x in out if x[6] - x[5] >= window]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["shard", "copy", "kind", "doc_id", "key_", "start", "text"]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return pieces.join(needs, ["doc_id", "key_"]).select("doc_id", "key_", "pieces", "needs").mapInArrow(cut, schema)


def matched(sent: DataFrame, window: int) -> DataFrame:
    """For each document and shard, runs of window starts found earlier (``hits``), and the text of the
    other windows (``rest``)."""
    schema = f"doc_id long, key_ long, hits {_RANGES}, rest {_PIECES}"

    def hold(table: pa.Table) -> pa.Table:
        table = table.append_column("asks", pc.equal(table.column("kind"), 2).cast(pa.int8()))
        table = table.sort_by([("asks", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        codes: dict[bytes, int] = {}
        shard = Automaton()
        begins: list[int] = []
        where: list[tuple[int, int]] = []
        out: dict[tuple[int, int], tuple[list, list]] = {}
        kinds, ids, keys, starts = (table.column(c).to_pylist() for c in ("kind", "doc_id", "key_", "start"))
        for i, text in enumerate(table.column("text")):
            words = text.as_py().split()
            hits, rest = out.setdefault((ids[i], keys[i]), ([], [])) if kinds[i] else ([], [])
            if kinds[i] < 2:
                shard.cut()
                begins.append(shard.size)
                where.append((ids[i], starts[i]))
                shard.add([codes.setdefault(w, len(codes)) for w in words])
                rest.append({"first": starts[i], "text": text.as_py()})
                continue
            found = np.zeros(len(words) - window + 1, bool)
            pairs = list(shard.matches([codes.get(w) for w in words], window))
            if pairs:
                at, ends = np.array(pairs).T
                begin = np.searchsorted(begins, ends, "right") - 1
                for k, b, e in zip(at.tolist(), begin.tolist(), ends.tolist(), strict=True):
                    ref_id, ref_start = where[b]
                    found[k] = (ref_id, ref_start + e - window + 1 - begins[b]) < (ids[i], starts[i] + k)
            edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if found[lo]:
                    hits.append({"first": starts[i] + lo, "last": starts[i] + hi - 1})
                else:
                    rest.append({"first": starts[i] + lo, "text": b" ".join(words[lo : hi + window - 1])})
        own = list(out)
        return pa.table(
            {
                "doc_id": pa.array([x[0] for x in own], pa.int64()),
                "key_": pa.array([x[1] for x in own], pa.int64()),
                "hits": pa.array([out[x][0] for x in own], _RANGE),
                "rest": pa.array([out[x][1] for x in own], _PIECE),
            }
        )

    return sent.groupBy("shard", "copy").applyInArrow(hold, schema)


def _left_over(hits: list[dict], rest: list[dict], window: int) -> list[dict]:
    """The windows of ``rest`` that no shard has found, as few pieces of text."""
    runs_: list[tuple[int, list[bytes]]] = []
    for piece in sorted(rest, key=lambda x: x["first"]):
        first, words = piece["first"], piece["text"].split()
        if runs_ and first <= runs_[-1][0] + len(runs_[-1][1]) - window + 1:
            begin, held = runs_[-1]
            held += words[max(0, begin + len(held) - first) :]
        else:
            runs_.append((first, words))
    out = []
    for begin, words in runs_:
        open_ = np.ones(len(words) - window + 3, bool)
        open_[[0, -1]] = False
        for x in hits:
            lo, hi = max(0, x["first"] - begin), min(len(open_) - 2, x["last"] - begin + 1)
            if lo < hi:
                open_[lo + 1 : hi + 1] = False
        edges = np.flatnonzero(np.diff(open_)).tolist()
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            out.append({"first": begin + lo, "text": b" ".join(words[lo : hi + window - 1])})
    return out


def _held(pieces: DataFrame, size: int, window: int, gram: int) -> DataFrame:
    """hits of each document, and the pieces that are left over."""
    found = staged(routes(pieces, window, gram, 1 + size // BUCKET_BYTES), "routes")
    sent = spans(pieces, found, window, gram, 1 + size // SHARD_BYTES)
    each = matched(sent, window).groupBy("doc_id", "key_").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("rest")).alias("rest")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("hits").to_pylist(), batch.column("rest").to_pylist(), strict=True)
            left = pa.array([_left_over(*x, window) for x in both], _PIECE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], left], ["doc_id", "key_", "hits", "pieces"])

    return staged(each.mapInArrow(merge, f"doc_id long, key_ long, hits {_RANGES}, pieces {_PIECES}"), "held")


def repeated(docs: DataFrame, *, window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """doc_id, key_ and ranges: the runs of window starts whose words also start earlier."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    piece = F.struct(F.lit(0).alias("first"), F.col("text").cast("binary").alias("text"))
    whole = docs.filter("text IS NOT NULL").select("doc_id", "key_", F.array(piece).alias("pieces"))
    hits = one = _held(whole, size, window, gram)
    lengths = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["text"]))
    left = one.agg(F.sum(lengths)).first()[0] or 0
    if left:
        rest = one.filter(F.size("pieces") > 0).select("doc_id", "key_", "pieces")
        hits = hits.unionByName(_held(rest, left, window, window))
    hits = hits.filter(F.size("hits") > 0)
    return hits.groupBy("doc_id", "key_").agg(F.flatten(F.collect_set("hits")).alias("ranges"))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = ANCHOR, keep: bool = True) -> DataFrame:
    """Remove every word inside a window whose words also start earlier in the corpus.

    A word is a run of characters that are not ASCII white space; a window is ``window`` words of one
    document; earlier is a smaller doc_id, or the same doc_id and a smaller start. Windows are judged on
    the input. Returns doc_id, n_words, n_removed, kept_sha256 and, with ``keep``, text (the kept words
    joined by one space) and removed (the ranges of words). A null or empty text has no words. A null
    doc_id comes before all others. Rows that share a doc_id are one document's rows: equal places in
    them are not earlier than each other. Other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text",
        F.crc32(F.col("text").cast("binary")).alias("key_"),
    )
    gone = repeated(rows, window=window, gram=gram)
    joined = rows.join(gone, ["doc_id", "key_"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if keep:
        schema += ", text string, removed array<struct<first:int,last:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = as_bytes(batch.column("text"))
            for text, ranges in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                words, kept, upto, removed = (text or b"").split(), [], 0, []
                for r in sorted(ranges or (), key=lambda r: r["first"]):
                    first, end = max(upto, r["first"]), r["last"] + window
                    if end > upto:
                        kept += words[upto:first]
                        removed.append({"first": first, "last": end - 1})
                        upto = end
                kept += words[upto:]
                body = b" ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest())
                out.append((*row, body.decode(), removed) if keep else row)
            columns = list(zip(*out, strict=True)) or [[]] * (5 if keep else 3)
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), span]
            names = ["n_words", "n_removed", "kept_sha256", "text", "removed"]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names[: len(arrays)]])

    return joined.mapInArrow(cut, schema).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID})"))
