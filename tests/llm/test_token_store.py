import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from attesta.llm import token_cache
from attesta.llm import token_store as ts
from attesta.llm.common import text_buffers
from attesta.llm.queries import op9_token_store

VOCAB = P.path("byte_bpe_50k.json")


def plain():
    t = Tokenizer.from_file(VOCAB)
    return t


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        h = ts.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_edges_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "SHARD_IDS", 50)
    rows = [(5, "hello world"), (-7, None), (3, ""), (3, "three"), (None, "no key"), (1 << 60, "x " * 300), (4, "<|endoftext|>"), (9, "é日🙂")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, ids int, p int").repartition(3)
    ts.write(df, f"{tmp_path}/t", VOCAB)
    got = sorted(((r.key is not None, r.key or 0, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in ts.read(spark, f"{tmp_path}/t").collect()), key=lambda r: r[2])
    t = plain()
    want = sorted(((k is not None, k or 0, t.encode(x or "", add_special_tokens=False).ids + [0]) for k, x in rows), key=lambda r: r[:2] + (r[2],))
    starts = [0, *accumulate(len(w[2]) for w in want)]
    assert [(g[0], g[1], g[4]) for g in got] == want or {(g[0], g[1], tuple(g[4])) for g in got} == {(w[0], w[1], tuple(w[2])) for w in want}
    assert [g[1] for g in got] == [w[1] for w in want]
    assert [g[2] for g in got][0] == 0 and all(a[2] + a[3] == b[2] for a, b in zip(got, got[1:], strict=False)) and got[-1][2] + got[-1][3] == starts[-1]
    found = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in ts.lookup(spark, f"{tmp_path}/t", [5, 9, 10, -8, 1 << 60]).collect()}
    assert set(found) == {5, 9, 1 << 60} and found[9] == t.encode("é日🙂", add_special_tokens=False).ids + [0]


def test_empty(spark, tmp_path):
    ts.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", VOCAB)
    assert ts.read(spark, f"{tmp_path}/e").count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    t, at = plain(), 0
    got = {r.doc_id: r for r in op9_token_store(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


#: Letters, digits, signs, contractions and white space of one to four bytes, what looks like white space, and the string of an added token.
PIECES = ["a", "Be", "\xe9", "\xdf", "ǅ", "ɿ", "ʀ", "ʰ", "Ω", "й", "日", "\U0001f642", "\xd7", "\xf7", "\xaa", "\xb2", "٣", "́", "1", "90", ",", ".)", "'", "'s", "'re", "s", "“", "–", " ", " ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\xa0", "　", " ", " ", " ", " ", "\x85", "\x1c", "\x1f", "﻿", "​", "᠎", "\x00", "<|endoftext|>"]


def block(texts):
    return text_buffers(pa.array(texts, pa.string()))


def ids_of(array, dtype):
    return [np.frombuffer(x, dtype).tolist() for x in array.to_pylist()]


def test_blocks_are_encoded_as_the_library_does():
    rng, t = np.random.default_rng(7), plain()
    for rare, most in ((0, 1000), (1, 1000), (0, 30)):  # with and without the added token, and with a cache that overflows
        enc = token_cache.ByteEncoder(t, most)
        for _ in range(60):
            texts = ["".join(PIECES[i] for i in rng.integers(0, len(PIECES) - 1 + rare, rng.integers(0, 25))) for _ in range(40)] + [None, "", " ", "\n", "  a", "x" * 200]
            assert ids_of(enc.ids(*block(texts), 0), enc.dtype) == [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
        assert len(enc.known) <= most


def test_python_sees_a_chunk_of_a_block_once(monkeypatch):
    enc, seen = token_cache.ByteEncoder(plain()), []
    values = enc._values
    monkeypatch.setattr(enc, "_values", lambda chunks: seen.append(len(chunks)) or values(chunks))
    texts = ["one two three, " * 500] * 40
    assert ids_of(enc.ids(*block(texts), 0), enc.dtype) == [plain().encode(texts[0], add_special_tokens=False).ids + [0]] * 40
    assert seen == [6]  # "one" with and without a space, "two", "three", the comma, the space at the end


def test_other_vocabularies_take_the_plainer_path(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    assert token_cache.byte_encoder(path) is None
    ts.write(spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string"), f"{tmp_path}/w", path)
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in ts.read(spark, f"{tmp_path}/w").collect()}
    assert got == {1: Tokenizer.from_file(path).encode("Hello world", add_special_tokens=False).ids + [0], 2: [0]}
