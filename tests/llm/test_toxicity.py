import math
import re
import zlib

import numpy as np
import pytest

from attesta.llm import toxicity
from attesta.llm.queries import learnable, op6_toxicity


def bags(texts, labels):
    out = []
    for t, y in zip(texts, labels, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        f, c, _, _ = toxicity.features(raw, np.array([0, len(raw)]))
        out.append((y, f, c))
    return out


def test_offending_sentence_is_found_from_document_labels(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    say = lambda: " ".join(rng.choice(words, 8))
    texts, labels = [], []
    for i in range(400):
        own = [say() for _ in range(6)]
        if i % 4 == 0:
            own[int(rng.integers(6))] += f" {rng.choice(['vilest', 'grotty'])} thing"
        texts.append(". ".join(own))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(bags(texts[:300], labels[:300]))
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in toxicity.score(df, model).collect():
        if r.doc_id >= 300:
            assert (r.score >= 0.5) == bool(labels[r.doc_id])
            where = [texts[r.doc_id].encode()[s.start : s.end].decode() for s in r.offending]
            assert all("vilest" in w or "grotty" in w for w in where) and bool(where) == bool(labels[r.doc_id])


def test_edges(spark):
    model = toxicity.train([])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "a. " * 100_000), (None, "é!")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out.values())
    assert out[1].score == out[2].score == out[3].score and out[1].n_sentences == 1 and out[4].n_sentences == 100_000
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df, spark.createDataFrame([], "doc_id long, label int")).bias < 0
    assert toxicity.fit(df, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (77, 1)], "doc_id long, label int")).bias > 0


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.85), ("sf0.1", 0.97)])
def test_held_out_accuracy(spark, sf, least):
    d = f"/root/testdata/{sf}"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op6_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    recall, kept = np.mean([p >= 0.5 for p in pos]), np.mean([n < 0.5 for n in neg])
    print(sf, "auc", auc, "recall", recall, "clean kept", kept, len(pos), len(neg))
    assert auc >= least and kept >= 0.95


def plain_sentences(text):
    """Feature ids of each sentence with words of a text, cut and read word by word."""
    out = []
    for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        ids = []
        for w in words:
            raw = np.frombuffer(w, np.uint8)
            ids += toxicity.features(raw, np.array([0, len(raw)]))[0].tolist()
        if words:
            out.append(ids)
    return out or [[]]


def test_query_equals_plain_noisy_or(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, learnable(spark.read.parquet(f"{d}/labels.parquet")))
    assert np.count_nonzero(model.weights) > 20
    weights = model.weights.astype(np.float32)
    got = {r.doc_id: r for r in op6_toxicity(spark, d).collect()}
    odd = [(-1, None), (-2, "é! ?\n\nA-b. " * 40), (-3, "..!")]
    got |= {r.doc_id: r for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    for k, text in [*((r.doc_id, r.text) for r in docs.collect()), *odd]:
        clean = 1.0
        for ids in plain_sentences(text):
            z = model.bias + math.fsum(float(weights[i]) for i in ids)
            clean *= 1 / (1 + math.exp(min(z, 700)))
        assert got[k].score == pytest.approx(1 - clean, abs=1e-5), k


def test_training_follows_the_slope_of_the_loss():
    texts = ["bad one. fine two", "bad three! fine", "bad. one", *["fine one. two", "three fine", "two three. fine", "one two", "three. one fine"] * 2]
    labels = [1] * 3 + [0] * 10
    own = bags(texts, labels)
    rounds, rate, ridge, share = 4, 0.15, 1e-4, np.mean(labels)
    docs = [[f[c[i] : c[i + 1]] for i in range(len(c) - 1)] for _, f, c in own]
    often, hits = {}, {}
    for (y, f, _), _ in zip(own, docs, strict=True):
        for x in set(f.tolist()):
            often[x], hits[x] = often.get(x, 0) + 1, hits.get(x, 0) + y
    keep = sorted(x for x, n in often.items() if n >= toxicity.MIN_DOCS and abs(hits[x] - n * share) > 2.5 * math.sqrt(n * share * (1 - share)))
    assert keep

    def loss(v):
        w, bias = dict(zip(keep, v[:-1], strict=True)), v[-1]
        total = ridge / 2 * sum(x * x for x in v[:-1])
        for y, sentences in zip(labels, docs, strict=True):
            clean = math.prod(1 / (1 + math.exp(bias + sum(w.get(x, 0.0) for x in s.tolist()))) for s in sentences)
            total += (0.5 / share * -math.log(1 - clean) if y else 0.5 / (1 - share) * -math.log(clean)) / len(labels)
        return total

    v = np.array([*[0.0] * len(keep), -6.0])
    m, s, before = np.zeros(len(v)), np.zeros(len(v)), loss(v)
    for t in range(1, rounds + 1):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-6 for e in np.eye(len(v)) * 1e-6])  # central differences
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    model = toxicity.train(own, rounds, rate, ridge)
    assert model.bias == pytest.approx(v[-1], abs=1e-3) and model.weights[keep] == pytest.approx(v[:-1], abs=1e-3) and loss(v) < before
