import hashlib
import random

import numpy as np
import pytest

from attesta.llm import suffix_dedup as sd
from attesta.llm.queries import op8_suffix_dedup


def brute(rows, length):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans or []), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    for _ in range(20):
        parts = [[r.randrange(1, 4) for _ in range(r.randrange(1, 200))] for _ in range(r.randrange(1, 4))]
        s = [x for p in [*parts, parts[0]] for x in [*p, 0]]
        rest = lambda i: s[i : s.index(0, i) + 1]  # noqa: B023, E731
        sa, words = sd.suffix_array(np.array(s, np.int16))
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: (rest(i), i))
        lcp = sd.common_prefixes(sa, words, np.array([0]), np.array([len(parts[0])]), 25)
        for i in range(1, len(s)):
            if sa[i] < len(parts[0]):
                a, b = rest(sa[i - 1]), rest(sa[i])
                n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)) + 25)
                assert min(lcp[sa[i]], len(b)) == min(n, 25, len(b))


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(2, 9)))
    vocab = [word() for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [text(n) for n in (8, 15, 20, 40, 90)]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(r.randrange(0, 4)):
            parts.append(text(r.randrange(0, 30)))
            if r.random() < 0.6:
                p = r.choice(passages)
                i = r.randrange(0, len(p) // 2)
                parts.append(p[i : i + r.randrange(20, 400)])
        rows.append((k * 31 % 150 * (10**15 if k == 7 else 1), " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "ab" * 2000), (1003, "\x00" * 250), (1004, "\x00" * 130), (1005, "x" * 99), (1006, "y" * 100), (1007, "y" * 100), (1008, rows[3][1])]
    return list(dict(rows).items())


@pytest.mark.parametrize("shard_bytes", [3_000_000, 400])
def test_edges_and_split_shards(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard_bytes)
    rows = make(1)
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, spans int, a string").repartition(7)
    for length in (100, 40):
        want, have = brute(rows, length), got(sd.suffix_dedup(df.drop("spans"), length))
        assert have == want, [(k, want[k], have[k]) for k in want if want[k] != have.get(k)][:4]


def test_null_ids_repeats_and_empty(spark):
    t = "the quick brown fox " * 7
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t)], "doc_id long, text string")
    out = sorted((r.doc_id or 9, r.n_removed) for r in sd.suffix_dedup(df).collect())
    assert out[0] == out[1] and out[2:] == [(4, 140), (9, 140)]
    assert sd.suffix_dedup(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_dedup(spark, d).collect()}
    want = brute(rows, 100)
    assert out == want, [(k, want[k], out.get(k)) for k in want if want[k] != out.get(k)][:4]


def test_contexts_are_as_many_however_the_rows_lie(spark, monkeypatch):
    counts = []

    def counting(df, stage=sd.stage):
        out = stage(df)
        if {"shard", "data"} <= set(out.columns):
            counts.append(out.count())
        return out

    monkeypatch.setattr(sd, "stage", counting)
    df = spark.createDataFrame(make(2), "doc_id long, text string")
    out = [got(sd.suffix_dedup(df.repartition(n, "doc_id"))) for n in (1, 24)]
    assert out[0] == out[1]
    assert len(counts) == 2 and counts[0] == counts[1] > 0
