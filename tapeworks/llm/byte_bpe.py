"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds all
tokens in a word. Encoding goes from longest match to longest match and steps back where two
neighbours could not stand side by side in a merged sequence; a position that failed is never tried
again, so the work is linear in the word. Whether two tokens may be neighbours is found once, by
undoing their merges, and kept in a memo.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.chunks import ChunkEncoder, Memo

#: Entries of one generation of a memo.
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """Plain merging, lowest rank first and leftmost among equals: the definition. With ``below``,
    only merges of a lower rank."""
    cuts = [piece[i : i + 1] for i in range(len(piece))]
    while len(cuts) > 1:
        found = [ranks.get(cuts[i] + cuts[i + 1]) for i in range(len(cuts) - 1)]
        best = min((r for r in found if r is not None), default=None)
        if best is None or (below is not None and best >= below):
            break
        i = found.index(best)
        cuts[i : i + 2] = [cuts[i] + cuts[i + 1]]
    return [ranks[x] for x in cuts]


class ByteBpe:
    """Encoder and decoder for one vocabulary; built once for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.fits = Memo(self._fits, MEMO)
        self.halves = Memo(self._halves, len(ranks) + 1)
        self.whole = Memo(lambda token: merged(token, ranks) == [ranks[token]], MEMO)
        self.pieces = Memo(self._piece, MEMO)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token), token))
        self.automaton.make_automaton()
        self.encode = ChunkEncoder(self._text, limit=MEMO)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """No merge across the border would have come before those that made the two tokens.

        Both are taken apart, the later merge first; at each step the two tokens at the border must
        not have a merge that ranks before the one just undone.
        """
        left, right = pair
        words, ranks, halves = self.words, self.ranks, self.halves
        limit = len(ranks) + 256
        while True:
            joined = ranks.get(words[left] + words[right])
            if joined is not None and joined < limit:
                return False
            split_left, split_right = halves[left], halves[right]
            if split_left is None and split_right is None:
                return True
            # Equal ranks merge from the left, so of two equal tokens the right one is undone first.
            if split_right is None or (split_left is not None and left > right):
                limit, left = left, split_left[1]
            else:
                limit, right = right + 1, split_right[0]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte."""
        word = self.words[token]
        return None if len(word) < 2 else tuple(merged(word, self.ranks, token))

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        size = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (rank, length, token) in self.automaton.iter(piece.decode("latin-1")):
            # A token that merging can't build never stands inside a longer piece.
            if length < 3 or self.whole[token]:
                starts[end + 1 - length].append((rank, end + 1))
        taken: list[int] = []
        ends = [0]
        tries = [len(starts[0])]
        dead = bytearray(size + 1)
        fits = self.fits
        while ends[-1] < size:
            at, left = ends[-1], tries[-1]
            options, last = starts[at], taken[-1] if taken else -1
            while left:
                left -= 1
                rank, end = options[left]
                if not dead[end] and (last < 0 or fits[last, rank]):
                    tries[-1] = left
                    taken.append(rank)
                    ends.append(end)
                    tries.append(len(starts[end]) if end < size else 0)
                    break
            else:
                if not taken:
                    raise ValueError(f"the vocabulary can't spell {piece!r}")
                dead[at] = 1
                taken.pop()
                ends.pop()
                tries.pop()
        return taken

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        return b"".join([self.pieces[x] for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        words = self.words
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()])


_BUILT: dict[tuple[int, str], ByteBpe] = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> ByteBpe:
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(ranks, pattern)
    return _BUILT[key]


def encode_decode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, keep: bool = True
) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its ids and the text decoded from them.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids (little-endian
    unsigned 32-bit) and decoded (bytes). A null or empty text has no ids; rows that repeat stay as
    they are; other columns are not read. The vocabulary (a file of about a megabyte) goes to the
    tasks with the code.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((ranks, pattern))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                back = codec.decode(ids)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest()]
                row.append(hashlib.sha256(back).hexdigest())
                out.append([*row, ids, back] if keep else row)
            columns = [list(x) for x in zip(*out, strict=True)] or [[]] * (5 if keep else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *arrays], names[: len(arrays) + 1]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
