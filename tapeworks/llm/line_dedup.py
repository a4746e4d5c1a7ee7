"""Line deduplication with two Bloom filters and an exact confirmation.

One pass puts every long line into a filter of lines seen once or into a second one of lines seen
again; the partitions' filters are merged piece by piece. A line that the second filter doesn't know
stands in one document only and never moves. The rest, with the few false alarms, is grouped by the
line itself, which decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.base import as_bytes, text_key
from tapeworks.session import staged

#: Bits of each filter: the bound of what is merged and broadcast (16 MB), whatever the input.
FILTER_BITS = 1 << 27
_PIECES = 64
_BLANK = b" \t\n\x0b\x0c\r"


class TwoFilters:
    """Lines seen, and lines seen again; two probes each."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.again = (np.zeros(bits // 8, np.uint8) for _ in range(2))

    def _probes(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        yield (hashes % np.uint64(self.bits)).astype(np.int64)
        yield ((hashes >> np.uint64(32)) % np.uint64(self.bits)).astype(np.int64)

    def known(self, which: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._probes(hashes):
            found &= (which[at >> 3] >> (at & 7) & 1).astype(bool)
        return found

    def put(self, which: np.ndarray, hashes: np.ndarray) -> None:
        for at in self._probes(hashes):
            np.bitwise_or.at(which, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """``hashes``: one for each line and document."""
        keys, counts = np.unique(hashes, return_counts=True)
        self.put(self.again, keys[(counts > 1) | self.known(self.once, keys)])
        self.put(self.once, keys)


def keys_of(text: bytes, min_chars: int) -> tuple[list[bytes], dict[bytes, list[int]]]:
    """A text's lines, and the line numbers of each key of ``min_chars`` code points or more."""
    lines = text.split(b"\n")
    keys: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_BLANK).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                keys.setdefault(key, []).append(i)
    return lines, keys


def seen_again(docs: DataFrame, *, min_chars: int, bits: int = FILTER_BITS) -> bytes:
    """The filter of lines that more than one document may hold, merged over all partitions."""
    size = bits // 8 // _PIECES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(bits)
        for batch in batches:
            hashes: list[int] = []
            for text in as_bytes(batch.column("text")):
                hashes += map(xxhash.xxh64_intdigest, keys_of(text or b"", min_chars)[1])
            if hashes:
                filters.add(np.array(hashes, np.uint64))
        pack = zstandard.ZstdCompressor(level=1)
        for piece in range(_PIECES):
            cut = slice(piece * size, (piece + 1) * size)
            if filters.once[cut].any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "piece": pa.array([piece], pa.int32()),
                        "once": [pack.compress(filters.once[cut].tobytes())],
                        "again": [pack.compress(filters.again[cut].tobytes())],
                    }
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, again = (np.frombuffer(open_(row[k]), np.uint8) for k in ("once", "again"))
                mine = held.setdefault(row["piece"], [np.zeros(size, np.uint8) for _ in range(2)])
                mine[1] |= again | (mine[0] & once)
                mine[0] |= once
        for piece, (_, again) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array([piece], pa.int32()), "again": [again.tobytes()]}
            )

    merged = (
        docs.select("text")
        .mapInArrow(build, "piece int, once binary, again binary")
        .repartition(_PIECES, "piece")
        .mapInArrow(merge, "piece int, again binary")
    )
    whole = bytearray(bits // 8)
    for row in merged.collect():  # bounded: the filter itself
        whole[row["piece"] * size : (row["piece"] + 1) * size] = row["again"]
    return bytes(whole)


def dedup_lines(
    docs: DataFrame,
    *,
    min_chars: int = 40,
    min_docs: int = 5,
    bits: int = FILTER_BITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drop lines held by ``min_docs`` documents or more, but for the largest doc_id that holds them.

    A line's key is the line without blanks at both ends, A-Z in lower case; keys under ``min_chars``
    code points are left alone. Returns doc_id, text (the kept lines), n_lines, n_dropped and, for
    columns named in ``carry``, the struct ``carried``. Every row is a document; rows that share the
    largest doc_id all keep the line. A null doc_id is smaller than any other. A null or empty text is
    one empty line. Columns not named are not read.
    """
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key_")]
    if carry:
        columns.append(F.struct(*carry).alias("carried"))
    rows = docs.select(*columns)
    again = spark.sparkContext.broadcast(seen_again(rows, min_chars=min_chars, bits=bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(8)
        filters.bits, known = bits, np.frombuffer(again.value, np.uint8)
        for batch in batches:
            found: list[tuple[int, bytes, list[int]]] = []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                found += [(i, k, v) for k, v in keys_of(text or b"", min_chars)[1].items()]
            if not found:
                continue
            hashes = np.array([xxhash.xxh64_intdigest(k) for _, k, _ in found], np.uint64)
            found = [found[i] for i in np.flatnonzero(filters.known(known, hashes))]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("key_").take(at),
                    pa.array([x[1] for x in found], pa.binary()),
                    pa.array([x[2] for x in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "key_", "line", "numbers"],
            )

    schema = "doc_id long, key_ long, line binary, numbers array<int>"
    moved = staged(rows.select("doc_id", "key_", "text").mapInArrow(suspects, schema), "lines")
    spread = (
        moved.groupBy("line")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    # Read back as a table of its own, so that a join can split the rows of a hot line.
    spread = staged(spread.select("line", "keeper"), "spread")
    drops = (
        moved.join(spread, "line")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "key_")
        .agg(F.flatten(F.collect_set("numbers")).alias("numbers"))
        .select(F.col("doc_id").alias("id_"), F.col("key_").alias("drop_key_"), "numbers")
    )
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("key_").eqNullSafe(F.col("drop_key_"))
    joined = rows.join(drops, same, "left").drop("id_", "drop_key_", "key_")
    kinds = {"doc_id": "long", "text": "string", "n_lines": "long", "n_dropped": "long"}
    if carry:
        kinds["carried"] = rows.schema["carried"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            texts = as_bytes(batch.column("text"))
            for text, gone in zip(texts, batch.column("numbers").to_pylist(), strict=True):
                lines, gone = (text or b"").split(b"\n"), set(gone or ())
                kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                out.append((b"\n".join(kept), len(lines), len(gone)))
            arrays = [
                batch.column("doc_id"),
                pa.array([x[0] for x in out], pa.binary()).cast(pa.string()),
                *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)),
            ]
            if carry:
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return joined.mapInArrow(cut, ", ".join(f"{k} {v}" for k, v in kinds.items()))
