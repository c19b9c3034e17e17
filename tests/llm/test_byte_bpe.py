"""Byte-level BPE: chunked encoding against the tiktoken library, decoding against the texts."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from roadlens.llm import byte_bpe
from roadlens.session import ensure_checkpoint_dir

PATTERN = public_tokenizers.PATTERN
ALPHABET = ["a", "b", "s", "re", "'", "'s", "'ll", "  ", " ", "\n", "\t ", "1", "22", "!", "?!", "é", "日本", " ", "࢏", "𝟘"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(3)
    mixed = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 90))) for _ in range(150)]
    runs = ["a" * 500, " " * 400 + "x", "!" * 200 + "'re they", "\n" * 70, "9" * 300, "x" + " " * 33 + "'s" * 60, "'" * 90 + "s"]
    return [None, "", " ", *mixed, *runs, "".join(mixed), "It's we'll 12 <|endoftext|>", "same", "same"]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (7, 7), (64, 5), (byte_bpe.CHUNK, byte_bpe.OVERLAP)])
def test_ids_and_bytes(spark, ranks, library, chunk, overlap):
    ensure_checkpoint_dir(spark)
    rows = [(i, t, "x", 1, b"") for i, t in enumerate(texts())] + [(None, "no id's", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, piece int, ids binary").repartition(3)
    encoded = byte_bpe.encode(docs, ranks, PATTERN, chunk=chunk, overlap=overlap)
    got = {r.doc_id: r for r in byte_bpe.digest(encoded, ranks).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        r = got[i]
        assert r.n_tokens == len(ids), (i, t)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    parts = {}
    for r in byte_bpe.decode(encoded[1], ranks).collect():
        parts.setdefault(r.doc_id, []).append((r.piece, bytes(r.bytes)))
    assert all(b"".join(x for _, x in sorted(p)).decode() == texts()[i] for i, p in parts.items() if i is not None)
    assert chunk > 1000 or max(map(len, parts.values())) > 3


def test_empty_table(spark, ranks):
    docs = spark.createDataFrame([], "doc_id string, text string")
    out = byte_bpe.digest(byte_bpe.encode(docs, ranks, PATTERN), ranks)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_every_stitch_is_a_true_boundary():
    scan = byte_bpe.Scanner(PATTERN, byte_bpe.newer_characters(PATTERN))
    rnd = random.Random(5)
    found = 0
    for _ in range(4000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(40))
        true = {0, *byte_bpe.boundaries(scan, text, 0, True)}
        at, chunk, overlap = rnd.randrange(len(text)), 12, 8
        window = text[at:at + chunk + overlap]
        place = byte_bpe.stitch(scan, window, chunk, at == 0, at + chunk + overlap >= len(text))
        if place is not None:
            found += 1
            assert at + place in true, (text, at, place)
    assert found > 3000


def test_one_pre_token_longer_than_many_chunks(spark, ranks, library):
    text = "start " + "ab" * 4000 + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = byte_bpe.digest(byte_bpe.encode(docs, ranks, PATTERN, chunk=100, overlap=20), ranks).first()
    ids = library.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
