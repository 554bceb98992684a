import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edges import documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm.byte_bpe import Decoder, Encoder, Vocabulary, decode, encode, replay

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def lines():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def vocabulary(lines):
    return Vocabulary.parse(lines)


@pytest.fixture(scope="module")
def library(lines):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TRICKY = [
    "", " ", "  \n\n \t x", "a" * 5000, " " * 3000 + "x", "ab" * 2000, "=-" * 500, "don't we'll I'VE", "\x1c\x1d   x",
    "<|endoftext|>", "٣٤٥ ²³ ⅷ", "naïve Ünïcödé 漢字かな 👩‍👩‍👧‍👦", "\u0000￿", "1234567890" * 30, "....!!!!????", "\r\n\r\n  \r\n",
]


def test_tricky_texts(vocabulary, library):
    encoder = Encoder(vocabulary, PATTERN)
    ids, bounds = encoder.encode(TRICKY)
    for k, text in enumerate(TRICKY):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text), text[:20]
    data, edges = Decoder(vocabulary).decode(ids, bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)] == TRICKY


@given(st.lists(st.text(), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    with open(PATH, "rb") as f:
        raw = f.read()
    vocabulary = _kept.setdefault("v", None) or _kept.update(v=Vocabulary.parse(raw)) or _kept["v"]
    library = _kept.get("l")
    if library is None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        library = _kept["l"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, bounds = Encoder(vocabulary, PATTERN).encode(texts)
    got = [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))]
    assert got == [library.encode_ordinary(t) for t in texts]


_kept: dict = {}


def test_random_bytes_as_words(vocabulary, library):
    """Words of any bytes, merged in one replay, come out as when each is merged alone."""
    rng = random.Random(3)
    alphabet = [b"th", b"e", b" ", b"ing", b"an", b"\xc3", b"\xa9", b"0", b"--", b"a", b"aa"]
    words = [b"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    ids, bounds = replay(vocabulary, words)
    for k, word in enumerate(words):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library._core_bpe.encode_single_piece(word)


def test_memory_of_words_is_bounded(vocabulary, library):
    encoder = Encoder(vocabulary, PATTERN, cache_words=10)
    for part in range(5):
        texts = [f"word{part}x{k} again" for k in range(20)]
        ids, bounds = encoder.encode(texts)
        assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(20)] == [library.encode_ordinary(t) for t in texts]
        assert len(encoder.codes) < 200


def test_tables(spark, library):
    frame = documents(spark, TRICKY)
    both = decode(encode(frame, ranks=PATH, pattern=PATTERN), ranks=PATH)
    assert set(both.columns) == {*frame.columns, "decoded"}
    rows = both.collect()
    assert len(rows) == frame.count()
    for r in rows:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    once = encode(frame, ranks=PATH, pattern=PATTERN, decoded="decoded")
    assert once.columns == both.columns and sorted(map(str, once.collect())) == sorted(map(str, rows))
    assert encode(nothing(spark), ranks=PATH, pattern=PATTERN, decoded="spans").collect() == []


def test_digests(spark, library, tmp_path):
    from larder.llm.queries import QUERIES

    documents(spark, TRICKY).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    expected = set()
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        digest = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode())]
        expected.add((doc_id, len(ids), *digest))
    assert {tuple(r) for r in QUERIES["op1_byte_bpe"](spark, str(tmp_path)).collect()} == expected


def test_unknown_ids_are_an_error(vocabulary):
    with pytest.raises(IndexError):
        Decoder(vocabulary).decode(np.array([10**6]), np.array([0, 1]))
