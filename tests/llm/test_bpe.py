import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from attesta.llm import bpe
from attesta.llm.token_cache import BYTE_CHUNKS, WORD_CHUNKS, encoder

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = ["the", " the", "  ", "\n", "\r\n", "\t", "'s", "'", "é", "é", "ß", "日本語", "🙂", "👩‍👩‍👧", "123", " 45", "\xa0", "　", "\x85", "\x1c", "\x00", "​", "﻿", "<|endoftext|>", "!!", "...", "a" * 70, "Σ", "İ", " ", "aaaa", "   \n  ", "½", "٣", "्", "_", "don't", "I'LL"]


def texts(n=400):
    r = random.Random(5)
    return ["", " ", "\n", *("".join(r.choice(PIECES) for _ in range(r.randrange(1, 30))) for _ in range(n))]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})


def test_equals_tiktoken_and_round_trips(spark, tik):
    ts = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ts)] + [(-1, None, "y")], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, RANKS, P.PATTERN, offsets=True), RANKS).collect()}
    assert got[-1].n_tokens == 0 and bytes(got[-1].decoded) == b""
    for i, t in enumerate(ts):
        want = tik.encode_ordinary(t)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, t
        assert bytes(got[i].decoded) == t.encode()
        assert got[i].starts == tik.decode_with_offsets(want)[1]


def test_long_runs_equal_tiktoken(tik):
    enc = bpe._encoder(RANKS, P.PATTERN)
    for t in (" " * 3001 + "x", "ab" * 2500, "\n" * 999, "=" * 777, "é" * 500):
        assert np.frombuffer(enc.ids([t])[0], "<u4").tolist() == tik.encode_ordinary(t)


def test_chunks_do_not_change_ids_of_library_files():
    from tokenizers import Tokenizer

    for name, chunks in (("byte_bpe_50k.json", BYTE_CHUNKS), ("word_bpe_49k.json", WORD_CHUNKS)):
        plain = Tokenizer.from_file(P.path(name))
        enc = encoder(P.path(name), chunks)
        for t, ids in zip(texts(), enc.ids(texts()), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_split_characters():
    assert "".join(bpe.decode_text([b"\xf0\x9f", b"\x99", b"\x82!"])) == "🙂!"
    assert bpe.decode_text([b"\xe2\x82"]) == ["�"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, RANKS, P.PATTERN).count() == 0


def test_query_on_data(spark, tik):
    from attesta.llm.queries import op2_bpe

    d = "/root/testdata/sf0.001"
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op2_bpe(spark, d).collect()}
    assert got.keys() == src.keys()
    for k, t in src.items():
        ids = tik.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
