"""Token ids in binary files: byte or bit planes of fixed-size blocks, zstandard and a chunk index.

A file holds the ids of whole documents. Its parts: chunks, then a footer in JSON, then the length of
the footer (8 bytes, little-endian) and a mark. A chunk is a block of ``BLOCK`` ids (the last one may be
shorter) written as planes: plane k holds byte k (or bit k) of every id, so the high planes, which
hardly change, shrink to almost nothing. Each plane is compressed on its own. The footer has for each
chunk its offset, number of ids and plane sizes, and for each run of documents their ids and lengths.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.base import text_key
from tapeworks.llm.chunks import ChunkEncoder, Memo
from tapeworks.session import scratch_path

MARK = b"PLANES01"
BLOCK = 1 << 16
END_ID = 0
#: About as many bytes of text go to one file.
FILE_BYTES = 32 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [x.tobytes() for x in np.packbits(np.unpackbits(rows, axis=1).T, axis=1)]
    return [x.tobytes() for x in np.ascontiguousarray(rows.T)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    if len(planes) == 32:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1)
        rows = np.packbits(np.unpackbits(packed, axis=1)[:, :count].T, axis=1)
    else:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(rows).view("<u4").ravel()


class _Out:
    """Writes one file under a name of its own and moves it into place when it is whole."""

    def __init__(self, path: str, bits: bool, block: int):
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        self.bits, self.block = bits, block
        self.pack = zstandard.ZstdCompressor(level=3)
        self.chunks: list[list] = []
        self.docs: list[list] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.offset = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids)])
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            self.flush(self.n_held - self.n_held % self.block)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for i in range(0, upto, self.block):
            part = ids[i : min(i + self.block, upto)]
            planes = [self.pack.compress(x) for x in to_planes(part, self.bits)]
            self.chunks.append([self.offset, len(part), [len(x) for x in planes]])
            for x in planes:
                self.out.write(x)
                self.offset += len(x)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self.flush(self.n_held)
        footer = {"block": self.block, "chunks": self.chunks, "docs": self.docs}
        text = zstandard.ZstdCompressor().compress(json.dumps(footer).encode())
        self.out.write(text + len(text).to_bytes(8, "little") + MARK)
        self.out.close()
        self.files.move(self.draft, self.path)


def read_file(path: str) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Each document of a file as the pieces of its ids; one chunk is held at a time."""
    files, path = fs.FileSystem.from_uri(path)
    with files.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"{path} is not a whole token file")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(zstandard.decompress(f.read_at(length, size - 16 - length)))

        def chunks() -> Iterator[np.ndarray]:
            for offset, count, sizes in footer["chunks"]:
                raw, at, planes = f.read_at(sum(sizes), offset), 0, []
                for n in sizes:
                    planes.append(zstandard.decompress(raw[at : at + n]))
                    at += n
                yield from_planes(planes, count)

        more, ids = chunks(), np.empty(0, "<u4")
        for doc_id, left in footer["docs"]:
            pieces = []
            while left:
                if not len(ids):
                    ids = next(more)
                pieces.append(ids[:left])
                ids, left = ids[len(pieces[-1]) :], left - len(pieces[-1])
            yield doc_id, pieces


#: The letter that stands for each byte: itself where it can be seen, else the next one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SEEN)}
_SPACE = chr(_SHOWN[32])
_LETTERS = [chr(_SHOWN.get(x, x)) for x in range(256)].__getitem__


class LibraryEncoder:
    """The tokenizers library over chunks, each met chunk or word encoded once.

    A text that spells one of the added tokens goes to the library whole, as only the whole text
    shows where such a token stands.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.tokenize = self.library.model.tokenize
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # With the split pattern of byte-level BPE, a space and a word of letters are one piece, which the
        # library's model takes as it is, without splitting and offsets.
        split = json.loads(definition).get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        unchanged = self.library.normalizer is None and plain.items() <= split.items()
        self.chunked = ChunkEncoder(self._library, self._word if unchanged else None)

    def _word(self, word: str) -> bytes:
        piece = word.replace(" ", _SPACE) if word.isascii() else "".join(map(_LETTERS, word.encode()))
        return array("I", [x.id for x in self.tokenize(piece)]).tobytes()

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        whole = any(x in text for x in self.added)
        return np.frombuffer((self._library if whole else self.chunked)(text), "<u4")


_ENCODERS = Memo(LibraryEncoder, 1)


def write_tokens(
    docs: DataFrame,
    definition: str,
    folder: str,
    *,
    n_files: int,
    bits: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text), end each document with id 0, write files in doc_id order.

    Returns the manifest: file_no, file, n_docs, n_ids. Null and empty texts hold the end id alone;
    a null doc_id comes first; rows that share a doc_id are ordered by a hash of their text, and rows
    equal in both stand side by side. Only text moves in the one shuffle; a lost task writes its file
    again under the same name. No documents give no files.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = _ENCODERS[tokens.value], None
        number = TaskContext.get().partitionId()
        path = f"{folder}/ids-{number:06d}.planes"
        for batch in batches:
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text"), strict=True
            ):
                out = out or _Out(path, bits, block)
                out.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END_ID)))
        if out:
            out.close()
            row = {"file_no": number, "file": path, "n_docs": len(out.docs), "n_ids": out.n_ids}
            yield pa.RecordBatch.from_pylist([row])

    order = ["doc_id", "_text_key"]
    return (
        docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("_text_key"))
        .repartitionByRange(n_files, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, "file_no long, file string, n_docs long, n_ids long")
    )


def read_tokens(spark: SparkSession, manifest: DataFrame, *, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, with ``keep``) of every document in the files.

    ``start`` counts the ids of all documents before it: the files' totals run up over the manifest
    (one row a file), the rest inside the file.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    ranged = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    if keep:
        schema += ", ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                start, rows = file["first"], []
                for doc_id, pieces in read_file(file["file"]):
                    crc = size = 0
                    for x in pieces:
                        crc, size = zlib.crc32(x.tobytes(), crc), size + len(x)
                    row = [doc_id, start, size, crc, file["file"]]
                    rows.append([*row, b"".join(x.tobytes() for x in pieces)] if keep else row)
                    start += size
                    if len(rows) >= 1000:
                        yield _rows(rows, keep)
                        rows = []
                if rows:
                    yield _rows(rows, keep)

    n_files = max(1, manifest.count())
    return ranged.repartition(n_files, "file_no").mapInArrow(run, schema)


def _rows(rows: list[list], keep: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "ids"][: 6 if keep else 5]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
    return pa.RecordBatch.from_arrays(columns, names)


def tokens_of(
    spark: SparkSession, docs: DataFrame, definition: str, *, bits: bool = False
) -> DataFrame:
    """Write the ids of ``docs`` to token files in the shared folder and read them back."""
    folder = scratch_path(spark, "token-files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    manifest_path = f"{folder}/manifest"
    write_tokens(
        docs, definition, f"{folder}/ids", n_files=1 + size // FILE_BYTES, bits=bits
    ).write.parquet(manifest_path)
    schema = "file_no long, file string, n_docs long, n_ids long"
    return read_tokens(spark, spark.read.schema(schema).parquet(manifest_path))
