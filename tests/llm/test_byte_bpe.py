import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import corpus, frame

from tapeworks.llm.byte_bpe import ByteBpe, encode_decode, merged, read_ranks

RANKS = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return ByteBpe(RANKS, P.PATTERN)


def test_pieces_merge_exactly(codec):
    rng, tokens = random.Random(1), list(RANKS)
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))[:40]
        assert codec.encode_piece(piece) == ([RANKS[piece]] if piece in RANKS else merged(piece, RANKS))
        piece = bytes(rng.choice(b"aeinst \xc3\xa9\xa0") for _ in range(rng.randint(1, 25)))
        assert codec.encode_piece(piece) == ([RANKS[piece]] if piece in RANKS else merged(piece, RANKS))


def test_small_vocabulary_with_dead_ends():
    ranks = {bytes([i]): i for i in range(256)}
    for token in (b"ab", b"bc", b"abc", b"cd", b"abcd", b"dd", b"bcd"):
        ranks[token] = len(ranks)
    codec, rng = ByteBpe(ranks, P.PATTERN), random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12)))
        assert codec.encode_piece(piece) == ([ranks[piece]] if piece in ranks else merged(piece, ranks))


def test_long_piece_is_linear(codec):
    piece = b"ab" * 20_000
    assert b"".join(codec.words[i] for i in codec.encode_piece(piece)) == piece


def test_rows(spark):
    rows = corpus(4) + [(None, "x"), (1, "again"), (1, "again"), (90, "a  b \n c <|endoftext|> don't É.")]
    got = encode_decode(frame(spark, rows, clash=True), RANKS, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i is None, i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), (t or "").encode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, bytes(r.decoded)) for r in got) == sorted(
        (a, b or 0, *c) for a, b, *c in want
    )
    assert encode_decode(frame(spark, []), RANKS, P.PATTERN).count() == 0
