import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from attesta.llm import packing
from attesta.llm.queries import op5_best_fit_packing


def valid(hist, bins, cap):
    left = dict(hist)
    for own, n in bins:
        assert sum(own) <= cap and n > 0
        for x in own:
            left[x] -= n
    assert not any(left.values())
    return sum(n for _, n in bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_whole_and_tight(seed):
    r = random.Random(seed)
    cap = r.choice([10, 37, 100, 2048])
    hist = {}
    for _ in range(r.choice([1, 7, 60, 3000])):
        x = r.randint(1, cap)
        hist[x] = hist.get(x, 0) + r.choice([1, 1, 5, 1000])
    bins = valid(hist, packing.plan(hist, cap).bins, cap)
    total = sum(x * n for x, n in hist.items())
    fit = packing.best_fit([hist.get(x, 0) for x in range(cap + 1)], cap)
    assert -(-total // cap) <= bins <= valid(hist, fit, cap)


def test_optimum_of_small_cases():
    # best fit needs 4 here, three suffice
    hist = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    assert packing.plan(hist, 10).size == 3
    assert packing.plan({}, 10).bins == []


def check(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def test_pack_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    rows = [(i % 97, i, 0, [3, 3, 3, 7, 10, 1][i % 6], "x") for i in range(600)] + [(None, 1, 0, 5, "y")] * 3
    df = spark.createDataFrame(rows, "id long, piece int, start long, length long, rank string")
    out = packing.pack(df, 10).collect()
    assert len(out) == 603 and check(out, 10) <= -(-sum(r[3] for r in rows) // 10) + 1
    assert packing.pack(df.limit(0), 10).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k] = (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
    rows = op5_best_fit_packing(spark, d).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check(rows, 2048)
    assert n <= -(-sum(v[1] for v in want.values()) // 2048) + 2, n


def fewest(items, cap):
    """The least number of bins, by trying every place of every item."""

    def go(rest, bins, best):
        if len(bins) >= best:
            return best
        if not rest:
            return len(bins)
        for i in range(len(bins)):
            if bins[i] + rest[0] <= cap:
                best = go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]], best)
        return go(rest[1:], [*bins, rest[0]], best)

    return go(sorted(items, reverse=True), [], len(items) + 1)


@pytest.mark.parametrize("limits", [(None, None), (packing.NODES, packing.LOOK), (0, 0), (50, 3)])
def test_small_cases_are_optimal_without_limits_and_whole_with_any(limits):
    for seed in range(60):
        r = random.Random(seed)
        cap = r.choice([10, 20, 30])
        items = [r.randrange(1, cap + 1) for _ in range(r.randrange(1, 9))]
        hist = {x: items.count(x) for x in items}
        got, least = packing.plan(hist, cap, *limits), fewest(items, cap)
        assert got.size == valid(hist, got.bins, cap) >= least >= got.bound
        assert not got.optimal or got.size == least
        assert limits[0] is not None or got.optimal


def test_planted_bins_and_equal_waste():
    assert packing.plan({51: 1, 46: 2, 41: 1, 33: 1, 30: 1, 26: 1, 19: 1, 8: 1}, 100).size == 3
    for parts in (4, 5):
        r, hist = random.Random(parts), {}
        for _ in range(300):
            cuts = sorted(r.sample(range(1, 2048), parts - 1))
            for a, b in zip([0, *cuts], [*cuts, 2048], strict=True):
                hist[b - a] = hist.get(b - a, 0) + 1
        assert packing.plan(hist, 2048).size <= 301


def test_new_columns_replace_those_of_the_same_name(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 7, 8, 9)], "id long, piece int, start long, length long, sequence_id int, __bucket int, __rank int")
    out = packing.pack(df, 10)
    assert out.columns == ["id", "piece", "start", "length", "__bucket", "__rank", "sequence_id", "offset"] and out.first()[4:] == (8, 9, 0, 0)


def test_many_small_pieces_a_bin():
    for histogram, capacity in (({3: 13_650_000}, 8192), ({5: 14_742_000}, 8192), ({2: 10_240_000}, 4097), ({1: 5_000_000, 7: 9_000, 4000: 600}, 8192)):
        found = packing.plan(histogram, capacity)
        used = {}
        for own, often in found.bins:
            assert sum(own) <= capacity
            for x in own:
                used[x] = used.get(x, 0) + often
        assert used == histogram and found.size == sum(n for _, n in found.bins) and found.bound <= found.size
        assert found.size == -(-sum(histogram.values()) // (capacity // min(histogram))) if len(histogram) == 1 else found.size == found.bound
