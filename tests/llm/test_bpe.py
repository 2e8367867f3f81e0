import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from stratalog.llm import bpe
from tests.llm.conftest import by_id

HARD = ["", "a" * 5000, " " * 40_000 + "x", "\n\n  x" * 9000, "日本" * 12_000, "!?" * 9000, "don't I'll " * 3000, "<|endoftext|>", "x" * 401, "   y", "é" * 300]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.vocabulary()), special_tokens={})


def test_ids_and_bytes_as_the_library(library):
    codec = bpe.Codec(bpe.vocabulary())
    for text in HARD:
        ids = library.encode_ordinary(text)
        assert codec.encode(text).tolist() == ids
        n, digest, raw, _ = codec.digest(text)
        assert (n, digest, raw) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_stitching_at_every_chunk_size():
    rng = random.Random(2)
    whole = bpe.Codec(bpe.vocabulary())
    parts = ["a", "'s", "  ", "\n", " ", "Zz", "12", "!!", "é", "日", "\t\t", " the", "'", "x" * 30, " " * 25]
    for chunk, overlap in ((40, 7), (9, 3), (100, 50)):
        whole.chunk, whole.overlap = chunk, overlap
        for _ in range(3000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
            assert whole.pretokenise(text) == whole.find.findall(text)


def test_tables(spark, docs_of, library):
    docs = docs_of([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x")]).selectExpr("*", "1 AS n_tokens", "2 AS ids")
    rows = by_id(bpe.digests(docs, bpe.vocabulary(), with_ids=True))
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[1].ids == []
    assert rows[3].ids == library.encode_ordinary("Hello world")
    back = by_id(bpe.decode(bpe.digests(docs, bpe.vocabulary(), with_ids=True), bpe.vocabulary()))
    assert bytes(back[3].raw) == b"Hello world" and bytes(back[1].raw) == b""
    assert bpe.digests(docs_of([]), bpe.vocabulary()).count() == 0


def test_own_merges_are_those_of_the_library(library):
    """merge_bytes alone, on pieces of all lengths, against the library's own."""
    codec, rng = bpe.Codec(bpe.vocabulary()), random.Random(8)
    tokens = [t for t in codec.ranks if len(t) > 1]
    for _ in range(3000):
        raw = b"".join(rng.choice(tokens) if rng.random() < 0.5 else bytes([rng.randrange(256)]) for _ in range(rng.randint(1, 12)))[: rng.choice([3, 30, 300])]
        text = raw.decode("latin-1")
        for piece in codec.find.findall(text):
            assert codec.merge_bytes(piece.encode()) == library.encode_ordinary(piece)
            assert codec.decode(codec.merge_bytes(piece.encode())) == piece.encode()


def test_chunks_stitched_in_any_place(library):
    rng = random.Random(3)
    tool = bpe.Codec(bpe.vocabulary())
    parts = ["a", "'s", "  ", "\n", " ", "Zz", "12", "!!", "é", "日", "\t\t", " the", "'", "x" * 30, " " * 25, "7" * 90]
    for size, overlap in ((40, 7), (9, 3), (100, 50)):
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
            chunks = [bpe.Chunk.of(tool, k, text[k : k + size]) for k in range(0, max(1, len(text) - overlap), size - overlap)]
            ids = [int(i) for part in bpe.stitched(tool, chunks) for i in part]
            assert ids == library.encode_ordinary(text), text


def test_long_texts_are_encoded_in_parallel_rows(spark, docs_of, library):
    rows = [(k, t * (1 + 3000 // max(1, len(t)))) for k, t in enumerate(HARD)] + [(50, HARD[2] * 3), (50, HARD[2] * 3), (None, HARD[2] * 3), (51, None)]
    found = bpe.digests(docs_of(rows).selectExpr("*", "1 AS key", "2 AS n", "3 AS start"), bpe.vocabulary(), with_ids=True, size=2000).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
