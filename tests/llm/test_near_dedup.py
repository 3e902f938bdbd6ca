import random
import re
from collections import defaultdict

import numpy as np

from attesta.llm import near_dedup as nd
from attesta.llm.components import components
from attesta.llm.queries import op4_minhash_near_dedup


def shingle_set(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, share):
    sets = {k: shingle_set(t, width) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    common = defaultdict(int)
    for own in by.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if share[1] * c >= share[0] * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.95, 0.85, 0.3):
        n = int(2000 * 2 * share / (1 + share))
        other = np.concatenate((base[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)))
        k = nd.bands(0.85) * nd.ROWS
        s = nd.sketches(nd.minhashes(np.concatenate((base, other)), np.array([0, 2000, 4000]), k))
        bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert (bits <= nd.most_bits(0.85, k)) == (share > 0.5)
        if share > 0.5:
            estimate = 1 + nd.BITS / (4 * k) * np.log(1 - 2 * bits / nd.BITS)
            assert abs(estimate - share) < 0.12


def test_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 5)
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(80)]
        for _ in range(15):  # a drifting chain: ends are unlike each other
            base = list(base)
            base[r.randrange(80)] = r.choice(words)
            texts.append(" ".join(base))
        for _ in range(8):  # copies whose distance from the first is near the threshold
            own = list(base)
            for _ in range(r.randrange(1, 6)):
                own[r.randrange(80)] = r.choice(words)
            texts.append("  ".join(own).upper())
    texts += ["one two", "ONE  two", "one", "", None, " \n", "a b c", "a b c d", "x " * 50_000, "x x x x"]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    df = spark.createDataFrame([(k, t, "key", 1) for k, t in rows], "doc_id long, text string, key string, component int").repartition(6)
    for width, share in ((3, (85, 100)), (5, (80, 100))):
        assert got(nd.near_dedup(df, width, share)) == brute(rows, width, share)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "Z"), (3, "q r s")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in nd.near_dedup(df, 3).collect())
    assert out == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(5, 5), (300, 300), (60, 59)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {q.id: q.component for q in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {k: find(k) for k in parent}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(op4_minhash_near_dedup(spark, d)) == brute(rows, 3, (85, 100))


def test_long_words_of_two_letters_are_told_apart(spark):
    for n in (1024, 4096):
        order = [bin(i).count("1") % 2 for i in range(n)]
        first, second = "".join("ab"[x] for x in order), "".join("ba"[x] for x in order)
        rows = [(0, first), (1, second), (2, first.upper()), (3, f"{first} x y z"), (4, f"{second} x y z")]
        assert got(nd.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (85, 100))) == brute(rows, 3, (85, 100))
