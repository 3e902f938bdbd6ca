import math
from decimal import Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest

from attesta.llm import queries, whitening

DATA = "/root/testdata/sf0.001"


def brute(vectors: dict, components: int, scale: int = 64, shift: int = 1_000_000):
    """Whole vectors by id, and by Python's own numbers: mean, covariance, deviations, eigenvalues."""
    x = {i: tuple(math.floor(scale * float(c)) + shift for c in v) for i, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    white = {i: np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ axes[:, ::-1][:, :components] / np.sqrt(values[::-1][:components]) for i, v in x.items()}
    return n, deviation, white, values[::-1][:components] / values.sum()


def same(rows, vectors, components):
    n, deviation, white, explained = brute(vectors, components)
    assert len(rows) == len(vectors) * components
    signs = {}
    for r in rows:
        assert (r.n, int(r.deviation)) == (n, deviation[r.id])
        want = white[r.id][r.component - 1]
        if r.component not in signs and abs(want) > 0.1:
            signs[r.component] = np.sign(want * r.whitened)
        if r.component in signs:
            assert r.whitened == pytest.approx(signs[r.component] * want, abs=1e-6)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6)
        assert r.identity_error < 1e-9


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    vectors = dict(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    rows = queries.QUERIES["op11_embedding_whitening"](spark, DATA).withColumnRenamed("vec_id", "id").collect()
    same(rows, vectors, 16)


def test_repeats_count_once_and_unfit_vectors_go(spark):
    rng = np.random.default_rng(5)
    vectors = {i: [float(v) for v in rng.normal(size=5)] for i in range(60)}
    vectors |= {100 + i: vectors[7] for i in range(200)}  # one vector with most rows
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] + [0.0] * 4), (904, [])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id bigint, embedding array<double>").selectExpr("*", "'a' AS component", "1 AS n", "vec_id AS id")
    out = whitening.whiten(df, components=3)
    assert out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(out.collect(), vectors, 3)


def test_null_and_repeated_ids_get_their_rows(spark):
    rows = [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [1.0, 3.0]), (1, [4.0, -1.0]), (2, [0.5, 0.5])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(out) == 10 and {r.n for r in out} == {4} and sum(r.id is None for r in out) == 4


def test_without_variance(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, None, 0.0, None)] * 4
    # two distinct vectors: one component has all the variance
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], "vec_id int, embedding array<double>")).collect()
    assert [(r.component, r.whitened is None) for r in out] == [(1, False), (2, True)] * 2
    assert {round(abs(r.whitened), 9) for r in out if r.component == 1} == {1.0}


def test_large_numbers_stay_exact(spark):
    rows = {1: [1e12, 3.0], 2: [-1e12, 4.0], 3: [5.0, 0.0]}
    out = whitening.whiten(spark.createDataFrame(list(rows.items()), "vec_id int, embedding array<double>")).collect()
    _, deviation, _, _ = brute(rows, 2)
    assert {r.id: r.deviation for r in out} == {i: Decimal(d) for i, d in deviation.items()}


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], empty.schema)).collect() == []
