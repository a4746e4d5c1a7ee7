"""Hashes of words and word runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from tapeworks.llm.chunks import Memo

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(Memo):
    """64-bit hashes of words; bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__(xxhash.xxh64_intdigest, limit)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash above 0 of each run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _STEP + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out | np.uint64(1)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x, done = pick(x[:-done], x[done:]), done * 2
    if done < width:
        x = pick(x[: len(x) - width + done], x[width - done :])
    return x
