import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, chat, common, suffix_dedup, toxicity
from attesta.llm.token_cache import BYTE_CHUNKS, WORD_CHUNKS, encoder


def test_range_key_finds_the_range(spark):
    r = random.Random(4)
    for n in (0, 1, 2, 3, 10, 57, 300):
        bounds = sorted(r.sample(range(-1000, 1000), n))
        values = [None, -(1 << 63), (1 << 63) - 1, *bounds, *(r.randrange(-1100, 1100) for _ in range(50))]
        df = spark.createDataFrame([(v,) for v in values], "v long").select("v", common.range_key(F.col("v"), bounds).alias("k"))
        assert all(x.k == (0 if x.v is None else sum(b <= x.v for b in bounds)) for x in df.collect())


def test_ranges_have_about_equal_weight(spark):
    df = spark.createDataFrame([(i, 1000 if i < 50 else 1) for i in range(1000)] + [(None, 5)], "k long, w long")
    bounds = common.range_bounds(df, "k", F.col("w"), 10)
    weights = [x.w for x in df.groupBy(common.range_key(F.col("k"), bounds).alias("p")).agg(F.sum("w").alias("w")).collect()]
    # beyond its share a range has one of the 40 quantiles (25 rows, give or take a few) at most
    assert len(bounds) <= 10 and max(weights) <= sum(weights) / 10 + 35 * 1000
    even = spark.createDataFrame([(i, 1 + i % 7) for i in range(2000)], "k long, w long")
    bounds = common.range_bounds(even, "k", F.col("w"), 10)
    weights = [x.w for x in even.groupBy(common.range_key(F.col("k"), bounds).alias("p")).agg(F.sum("w").alias("w")).collect()]
    assert len(weights) >= 8 and max(weights) <= 1.5 * sum(weights) / 10
    assert common.range_bounds(df.limit(0), "k", F.col("w"), 10) == [] and common.range_bounds(df, "k", F.col("w"), 1) == []


def test_one_text_a_key(spark):
    plain = spark.createDataFrame([(5, "a"), (3, None)], "id long, t string")
    assert sorted((r.id, r.k) for r in common.one_text_a_key(plain, "id", "t", "k").collect()) == [(3, 3), (5, 5)]
    odd = spark.createDataFrame([(5, "a", 1), (3, "b", 2), (3, "b", 3), (3, "c", 4), (None, "z", 5), (None, None, 6)], "id long, t string, n int")
    got = {r.n: r.k for r in common.one_text_a_key(odd, "id", "t", "k").collect()}
    assert got[2] == got[3] != got[4] and got[5] != got[6] and max(got[2], got[4]) < got[1] < min(got[5], got[6])


def test_strings_of_added_tokens_are_those_tokens():
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|><|endoftext|>y", "<|endoftext", "<|ENDOFTEXT|>", "é<|endoftext|>\n\n<|startoftext|> ", " <|endoftext|>", "none"]
    for name, chunks in (("byte_bpe_50k.json", BYTE_CHUNKS), ("word_bpe_49k.json", WORD_CHUNKS)):
        plain = Tokenizer.from_file(P.path(name))
        for t, ids in zip(texts, encoder(P.path(name), chunks).ids(texts), strict=True):
            assert list(memoryview(ids).cast("I")) == plain.encode(t, add_special_tokens=False).ids, t


def test_names_of_new_columns(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "x", "z")], "doc_id long, ids string, text string")
    with pytest.raises(ValueError, match="columns of the result"):
        bpe.encode(df, ranks, P.PATTERN, keep=("doc_id", "ids"))
    with pytest.raises(ValueError, match="columns of the result"):
        toxicity.score(df.withColumn("score", F.lit(1)), toxicity.train([]), keep=("doc_id", "score"))
    out = bpe.decode(bpe.encode(df, ranks, P.PATTERN, keep=("doc_id", "text")).withColumn("decoded", F.lit(1)), ranks)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and bytes(out.first().decoded) == b"z"


def test_suffix_dedup_with_clashing_columns_and_cut_text(spark):
    t = "the quick brown fox é " * 7
    df = spark.createDataFrame([(1, t, 5, 6, 7, 8), (2, "ab" + t, 5, 6, 7, 8), (3, None, 5, 6, 7, 8)], "doc_id long, text string, kept int, N_Bytes int, spans int, __key int")
    out = suffix_dedup.suffix_dedup(df, cut_text=True)
    assert out.columns == ["doc_id", "text", "__key", "n_bytes", "n_removed", "spans"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].n_removed == 0 or rows[1].text != t
    assert rows[2].text.startswith("ab") and rows[2].n_removed > 100 and rows[2]["__key"] == 8 and rows[3].text is None


def test_windows_and_templates_that_rewrite(spark):
    turns = [(k, i, "user" if i % 2 == 0 else "assistant", f"t{k}-{i} ") for k in (1, 2) for i in range(9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = [sorted(map(tuple, chat.digests(chat.format_chats(df, window=w)).collect())) for w in (None, 1, 2, 64)]
    assert rows[0] == rows[1] == rows[2] == rows[3] and all(r[1] == 9 for r in rows[0])

    def forgets(messages):  # only the last three turns are shown
        return "|".join(t for _, t in messages[-3:])

    got = chat.digests(chat.format_chats(df, forgets)).collect()
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars) for r in got) == [(1, 9, None, None), (2, 9, None, None)]


def test_numbers_below_the_prime():
    r = np.random.default_rng(4)
    p = common.PRIME
    a, b = (np.concatenate((r.integers(0, p, 2000, dtype=np.uint64), np.array([0, 1, p - 1, p - 1], np.uint64))) for _ in range(2))
    assert common.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    up, down = common.prime_powers(5000)
    assert up[4999] == pow(common._PRIME_BASES[0], 4999, p) and all(common.times(up, down) == 1)
    runs = common.Runs(np.tile(a[:40], 30))
    assert len({int(runs.hash(np.array([i]), np.array([i + n]))[0]) for i in range(0, 1200, 40) for n in (7, 8)}) == 2


def test_ranges_do_not_grow_without_bound(spark):
    n = common.partitions(spark)
    assert common.ranges(spark, 0, 100) == n and common.ranges(spark, 100 * (n + 1), 100) == n + 1
    assert common.ranges(spark, 10**18, 1 << 23) == n * common.RANGES
