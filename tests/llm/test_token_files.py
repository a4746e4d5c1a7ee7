import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from cases import corpus, frame
from tokenizers import Tokenizer

from tapeworks.llm import token_files as tf

with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()
LIBRARY = Tokenizer.from_str(DEFINITION)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    planes = tf.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (tf.from_planes(planes, n) == ids).all()


def test_chunks_encode_as_the_library():
    encode = tf.LibraryEncoder(DEFINITION)
    texts = [t or "" for _, t in corpus(5)] + [
        "a  b", "a \n b", "a\n b ", " a", "a ", "\n\n x", "don't  won't", "x<|endoftext|>y", " <|endoftext|>",
        "É. È, ß! 3.5 a  b", "a　 b", "…. ?! .", "tab\t tab", "ªº. ǅ. ʰ. ١.",
    ]
    for text in texts:
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_all_ids_in_order(spark, tmp_path, bits):
    rows = corpus(7) + [(None, "first"), (3, "same id"), (3, "same id")]
    folder = f"file://{tmp_path}/ids"
    manifest = tf.write_tokens(frame(spark, rows, clash=True), DEFINITION, folder, n_files=3, bits=bits, block=64)
    path = str(tmp_path / "manifest")
    manifest.write.parquet(path)
    got = tf.read_tokens(spark, spark.read.parquet(path), keep=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    texts, start = {}, 0
    for i, t in rows:
        texts.setdefault(i, []).append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        texts[r.doc_id].remove(ids)
        start += r.n_tokens
    assert not any(texts.values())
    assert not [x for x in os.listdir(tmp_path / "ids") if not x.endswith(".planes")]


def test_no_documents_and_broken_file(spark, tmp_path):
    assert tf.tokens_of(spark, frame(spark, []), DEFINITION).count() == 0
    (tmp_path / "x").write_bytes(b"short, but long enough")
    with pytest.raises(ValueError, match="whole token file"):
        list(tf.read_file(f"file://{tmp_path}/x"))


def test_plain_words_encode_as_the_library():
    encode = tf.LibraryEncoder(DEFINITION)
    letters = [chr(x) for x in range(0x250) if chr(x).isalpha()]
    rng = np.random.default_rng(2)
    for _ in range(3000):
        word = " " + "".join(rng.choice(letters, int(rng.integers(1, 14))))
        assert encode("x" + word).tolist()[-1:] and encode(word).tolist() == LIBRARY.encode(word).ids, word


def test_lines_encode_as_the_library():
    encode = tf.LibraryEncoder(DEFINITION)
    rng = np.random.default_rng(4)
    parts = ["word", "Über", "x.", "\n", "\n", " ", "'s", "12", "!!", "\t", "ß,", "\r\n", "\u2028", "a\u0301", "|", "’"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 9))))
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)
