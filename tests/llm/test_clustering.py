import hashlib
import math

import duckdb
import numpy as np

from attesta.llm import clustering, queries

DATA = "/root/testdata/sf0.001"


def brute(rows, k, rounds, dims, scale=1024, salt="3"):
    """Lloyd's rounds over all vectors, in Python's own numbers."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in kept]
    for _ in range(rounds):
        owners = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, owners, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    owners = assign()
    distance = [far(x, centroids[o]) for (_, x), o in zip(kept, owners, strict=True)]
    inertia = {j: sum(d for d, o in zip(distance, owners, strict=True) if o == j) for j in set(owners)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is not None, i or 0), o, d, inertia[o], sum(distance), sha[o]) for (i, _), o, d in zip(kept, owners, distance, strict=True))


def plain(out):
    return sorted(((r[0] is not None, r[0] or 0), r[1], r[2], int(r[3]), int(r[4]), r[5]) for r in out.collect())


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = c.sql(queries.ORACLES["op13_centroid_clustering"])
    out = queries.QUERIES["op13_centroid_clustering"](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in rng.normal(i % 4, 1, 3)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # one vector has a third of the rows
    rows += [(7, rows[3][1]), (7, rows[7][1]), (None, rows[9][1]), (None, [0.0, 0.0, 0.0])]  # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [1.0, float("nan"), 2.0]), (2005, [float("-inf"), 0.0, 0.0]), (2006, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS key", "0 AS owner", "1 AS id", "2 AS distance")
    for k, rounds in ((4, 10), (6, 2), (3, 0), (1, 3)):
        assert plain(clustering.cluster(df, k=k, rounds=rounds, dims=3)) == brute(rows, k, rounds, 3)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)]  # all centroids are equal; only the first owns anything
    out = clustering.cluster(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), k=3, dims=2)
    assert {r.cluster for r in out.collect()} == {0} and plain(out) == brute(rows, 3, 10, 2)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(5, [1.0, 0.0]), (6, [0.0, 1.0])]
    assert plain(clustering.cluster(spark.createDataFrame(rows, schema), dims=2)) == brute(rows, 8, 10, 2)
    assert clustering.cluster(spark.createDataFrame([], schema), dims=2).collect() == []
    assert clustering.cluster(spark.createDataFrame([(None, [1.0, 0.0])], schema), dims=2).collect() == []  # no id, no seed


def test_only_what_changed_is_compared():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (7, 4))
    owner, distance = clustering.nearest(x, np.full(400, -1), np.zeros(400, np.int64), c, np.arange(7))
    full = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (owner == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    moved = np.array([1, 4])
    c[moved] += rng.integers(-9, 9, (2, 4))
    owner, distance = clustering.nearest(x, owner, distance, c, moved)
    full = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (owner == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    large = np.array([[2**27, -(2**27)], [0, 1]])
    assert clustering._distances(large, large).tolist() == [[0, 2**54 + (2**27 + 1) ** 2], [2**54 + (2**27 + 1) ** 2, 0]]


def test_rounds_join_without_a_shuffle(spark):
    rows = spark.range(50).selectExpr("id", "array(id, -id) AS x", "id AS key")
    from attesta.llm.vectors import bucketed, discard

    a, *one = bucketed(rows.repartition(4, "key"), "key", 4)
    b, *two = bucketed(rows.selectExpr("key", "0 AS owner", "id AS distance"), "key", 4)
    plan = a.join(b.hint("shuffle_hash"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    discard(spark, *one)
    discard(spark, *two)
