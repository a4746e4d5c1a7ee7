"""Text in chunks that byte-level BPE encodes apart, and memos of what they encode to.

The split pattern of byte-level BPE never joins what stands before a space with what follows it,
if neither neighbour of the space is white space: the space begins a new match. So a text cut
before such spaces gives the same matches piece by piece, and a chunk met again needs no second
encoding. Texts with runs of white space that hold a space are not cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Wider than any engine's white space; a text in doubt is only encoded uncut.
_WIDE = "".join([r"\s", *map(chr, (0x85, 0x180E, 0x200B, 0x2060, 0xFEFF))])
_UNSAFE = re.compile(rf" [{_WIDE}]|[{_WIDE}] ")


class Memo(dict):
    """Bounded memo in two generations: a full one becomes the old one, from which what is asked for
    again is taken over, so common keys stay and a worker's memory does not grow."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: Marks that stand apart from a word of the letters below _PLAIN before them.
_MARKS = frozenset(".,;:!?")
_PLAIN = chr(0x250)


def _is_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) < _PLAIN)


def _solid(char: str) -> bool:
    """Neither white space for any engine nor part of a wider sign."""
    return "!" <= char <= "~" or (char < _PLAIN and char.isalnum())


class _Chunks(Memo):
    """Ids of what follows a space (or nothing, for ``before`` empty). A word with a mark behind it is put
    together, not kept; so are, with ``word``, the lines of a chunk."""

    def __init__(
        self, encode: Callable[[str], bytes], limit: int, word: Callable[[str], bytes] | None, before: str = " "
    ):
        def make(rest: str) -> bytes:
            return (word if word and _is_word(rest) else encode)(before + rest)

        super().__init__(make, limit)
        self.marks = {x: encode(x) for x in _MARKS}
        self.line = encode("\n") if word else None
        self.bare = _Chunks(encode, limit, word, "") if word and before else self

    def __missing__(self, rest: str) -> bytes:
        if rest.isalpha():
            return super().__missing__(rest)
        if self.line is not None and "\n" in rest:
            # One line feed between two solid characters is a piece of its own.
            head, _, tail = rest.partition("\n")
            if head and tail and _solid(head[-1]) and _solid(tail[0]):
                return self[head] + self.line + self.bare[tail]
        elif rest[-1:] in _MARKS:
            word = rest[:-1]
            if _is_word(word):
                return self[word] + self.marks[rest[-1]]
        return super().__missing__(rest)


class ChunkEncoder:
    """``encode`` maps any text to packed ids; texts are cut where that changes nothing. At most twice
    ``limit`` chunks are kept. ``word`` is given where the split pattern makes one piece of a word of letters
    with or without a space before it, and of a single line feed: it maps such words, at less cost."""

    def __init__(
        self, encode: Callable[[str], bytes], word: Callable[[str], bytes] | None = None, limit: int = 700_000
    ):
        self.encode = encode
        self.after_space = _Chunks(encode, limit, word)

    def __call__(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        memo = self.after_space
        return b"".join([self.encode(first) if first else b"", *[memo[x] for x in rest]])
