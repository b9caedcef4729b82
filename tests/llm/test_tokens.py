"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import bpe, count, queries

RANKS = P.path("byte_bpe_50k.tiktoken")
EDGES = ["", " ", "  a", "a  ", "\n", "a\n\n b", "it's   fine\t\n", "é" * 300, "x" * 5000, " " * 3000, "\x1c\x85 a", "中文 和 日本語", "😀😀 a", "aaa aaaa", "١٢٣ ½", "<|endoftext|>", "a\r\nb", "é"]


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return bpe.Encoder(bpe.Compiled(ranks), P.PATTERN), bpe.Decoder(ranks), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text: str) -> np.ndarray:
    return np.array(text.split(), dtype=np.int64)


@given(st.text(max_size=60) | st.lists(st.sampled_from([*EDGES, "a", " the", "ing", "'s", "1"]), max_size=8).map("".join))
@settings(max_examples=400, deadline=None)
def test_encodes_as_the_library(coder, text):
    encoder, decoder, library = coder
    got = encoder.encode_text(text)
    assert got == " ".join(map(str, library.encode_ordinary(text)))
    assert decoder.decode(ids(got)) == text


def test_lookahead_and_reset(coder, monkeypatch):
    """Small tables give the same ids."""
    monkeypatch.setattr(bpe, "STATE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 4)
    fresh = bpe.Encoder(coder[0].machine.compiled, P.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 14))) for _ in range(4))
        assert fresh.encode_text(text) == " ".join(map(str, coder[2].encode_ordinary(text)))


def test_texts_at_once(coder, monkeypatch):
    """Blocks of texts share what is kept, whatever it is bounded to; long pre-tokens leave the common steps."""
    monkeypatch.setattr(bpe, "CALL_BYTES", 40)
    rng = random.Random(4)
    texts = [rng.choice(EDGES) + " ".join("".join(rng.choice("abeinrstéё1") for _ in range(rng.choice([1, 5, 9, 200]))) for _ in range(6)) for _ in range(120)]
    want = [coder[2].encode_ordinary(t) for t in texts]
    for most in (5, 10**6):
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", most)
        monkeypatch.setattr(bpe, "CHAIN_ENTRIES", 50 * most)
        fresh = bpe.Encoder(coder[0].machine.compiled, P.PATTERN)
        assert [ids(x).tolist() for k in range(0, 120, 40) for x in fresh.encode_texts(texts[k : k + 40])] == want


def test_stream(coder):
    """Tokens leave before the end of a long pre-token; a table without all bytes is an error."""
    piece = b"the" * 400
    assert list(coder[0].machine.stream(piece)) == coder[2].encode_ordinary(piece.decode()) == coder[0].machine.encode(piece)
    taken = 0

    def feed():
        nonlocal taken
        for byte in piece:
            taken += 1
            yield byte

    next(coder[0].machine.stream(feed()))
    assert taken < 200
    short = bpe.Transducer(bpe.Compiled({b"a": 0, b"b": 1, b"ab": 2}))
    assert short.encode(b"aab") == [0, 2]
    for run in (short.encode, lambda x: list(short.stream(x))):
        with pytest.raises(ValueError, match="byte"):
            run(b"ac")


def test_incremental_decoding(coder):
    data = "aé中😀\x00z".encode()
    for size in (1, 2, 3, 5):
        machine = bpe.Utf8Machine()
        parts = [machine.feed(data[k : k + size]) for k in range(0, len(data), size)] + [machine.close()]
        assert "".join(parts) == data.decode()
    for bad in (b"\xff", b"\xe4\xb8", b"\xc0\xaf", b"\xed\xa0\x80", b"a\xf0\x9f\x98", b"\x80a"):
        machine = bpe.Utf8Machine()
        assert "".join([machine.feed(bad[k : k + 1]) for k in range(len(bad))] + [machine.close()]) == bad.decode("utf-8", "replace")
    with pytest.raises(ValueError, match="id"):
        coder[1].decode(np.array([10**6]))
    assert "".join(coder[1].stream(coder[2].encode_ordinary("é中 a"))) == "é中 a"


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a é", 9), (1, "a é", 9), (2, None, 8), (3, "", 7), (4, "word " * 40_000, 6)], "doc_id long, text string, n_tokens int")
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert {(r["doc_id"], r["decoded"] if r["doc_id"] < 4 else len(r["decoded"]), r["n_tokens"] == len(r["ids"])) for r in out.collect()} == {(1, "a é", True), (2, "", True), (3, "", True), (4, 200_000, True)}
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark, data, coder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = coder[2].encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.fixture(scope="module")
def counter():
    path = P.path("word_bpe_49k.json")
    return count.Counter(open(path, "rb").read()), Tokenizer.from_file(path)


@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from([*EDGES, "Σ", "aΣ ", "İ", "K", "ǅ", "<|startoftext|>", "<|ENDOFTEXT|>", "The", "aaaa"]), max_size=6).map("".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_counts_as_the_library(counter, texts):
    assert counter[0].count(texts) == [len(e.ids) for e in counter[1].encode_batch(texts, add_special_tokens=False)]


def test_count_query(spark, data, counter):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op4_token_counts(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(counter[1].encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 30_000, 3)], "doc_id long, text string, n_bytes int")
    got = {r["doc_id"]: r["n_bytes"] for r in count.count_tokens(odd, P.path("word_bpe_49k.json"), 10).collect()}
    assert got == {1: 0, 2: 0, 3: 30_000}
