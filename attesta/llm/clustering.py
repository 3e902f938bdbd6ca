"""Clusters around centroids by Lloyd's rounds that touch only what changed.

Vectors and centroids are whole numbers, so sums, distances and ties are exact.
Vectors are written once, in buckets of a running number; the assignment of
each (owner and squared distance) is a narrow table in the same buckets, so a
round joins the two without a shuffle.  A round compares

* a vector whose owner moved with all centroids,
* any other vector with its known distance and the centroids that moved.

Sums of the clusters stay on the driver, k times (d + 1) numbers: a vector that
changes its owner is taken from one sum and added to another, and these signed
transfers are summed per batch, per partition and then over all.  A round in
which nothing moves ends the work, as later rounds could change nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import column, partitions, tidy
from attesta.llm.vectors import bucketed, discard, matrix, slices, whole_vectors


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, by GEMM where doubles hold them."""
    if 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) ** 2 < 1 << 52:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        apart = x - c[j]
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance after the centroids ``moved`` did; an owner of -1 is none. Of equally near centroids the first counts."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | np.isin(owner, moved)
    if anew.any():
        all_of = _distances(x[anew], centroids)
        owner[anew] = all_of.argmin(axis=1)
        distance[anew] = all_of.min(axis=1)
    if len(moved) and not anew.all():
        rest = np.flatnonzero(~anew)
        some = _distances(x[rest], centroids[moved])
        best, by = some.min(axis=1), moved[some.argmin(axis=1)]
        better = (best < distance[rest]) | ((best == distance[rest]) & (by < owner[rest]))
        owner[rest[better]], distance[rest[better]] = by[better], best[better]
    return owner, distance


def _transfers(x: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters that gave or took, and for each the signed count and sums of what it took."""
    moved = old != new
    total = np.zeros((k, x.shape[1] + 1), np.int64)
    rows = np.concatenate((np.ones((int(moved.sum()), 1), np.int64), x[moved]), axis=1)
    np.add.at(total, new[moved], rows)
    left = old[moved] >= 0
    np.subtract.at(total, old[moved][left], rows[left])
    touched = np.unique(np.concatenate((new[moved], old[moved][left])))
    return touched, total[touched]


def _assign(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray, id_type: T.DataType) -> DataFrame:
    """(key, id, owner, distance) of every vector, and on one row of each batch its transfers."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, moved))
    k, dims = centroids.shape

    @tidy
    def run(batches):
        centroids, moved = sent.value
        for batch in batches:
            for part in slices(batch, dims):
                x = matrix(column(part, "x"), dims)
                old, known = column(part, "owner").to_numpy(zero_copy_only=False).astype(np.int64), column(part, "distance").to_numpy(zero_copy_only=False)
                owner, distance = nearest(x, old, known, centroids, moved)
                touched, sums = _transfers(x, old, owner, k)
                first = [touched.tolist() if len(touched) else None], [sums.ravel().tolist() if len(touched) else None]
                lists = [pa.concat_arrays([pa.array(v, t), pa.nulls(part.num_rows - 1, t)]) for v, t in zip(first, (pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "key"), column(part, "id"), pa.array(owner.astype(np.int32)), pa.array(distance), *lists], names=["key", "id", "owner", "distance", "touched", "sums"])

    long, whole = T.LongType(), T.IntegerType()
    fields = [("key", long), ("id", id_type), ("owner", whole), ("distance", long), ("touched", T.ArrayType(whole)), ("sums", T.ArrayType(long))]
    return rows.select("key", "id", "x", "owner", "distance").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _total(state: DataFrame, dims: int) -> list:
    """(cluster, place, value) rows of all transfers: place 0 is the count. At most k * (dims + 1)."""

    @tidy
    def run(batches):
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(dims + 1, object))
        for batch in batches:
            for touched, sums in zip(column(batch, "touched").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
                for c, row in zip(touched, np.array(sums, object).reshape(-1, dims + 1), strict=True):
                    total[c] += row
        rows = [(c, p, str(v)) for c, row in total.items() for p, v in enumerate(row) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["cluster", "place", "value"])

    found = state.filter("touched is not null").select("touched", "sums").mapInArrow(run, "cluster int, place int, value string")
    return found.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of ``salt:id``, null ids left out; of one id the vectors in ascending order."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    found = vectors.filter("id is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` of Lloyd's algorithm.

    Kept are vectors of exactly ``dims`` entries, all finite, and of a size of
    which squared distances fit in a long (2^17 for 64 entries and a scale of
    1024); an entry c counts as floor(scale * c).  Null ids are rows like others,
    but seed no centroid; repeated rows count as often as they come.  Fewer
    vectors with ids than ``k`` make fewer centroids; without any the result is
    empty.  Empty clusters keep their centroid.  Ties go to the smaller number.
    Other columns are left behind and may have any name.  ``inertia`` is a
    decimal, the sum of squared distances of all; centroids are told by the
    SHA-256 of their entries, joined by commas.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    id_type = df.schema[id_col].dataType
    limit = math.isqrt((1 << 63) // max(1, dims)) // 2
    vectors = whole_vectors(df, id_col, vector_col, dims, scale, limit=limit)
    centroids = seeds(vectors, k, salt)
    result = "id, cluster, distance, cluster_inertia, inertia, centroid_sha256".split(", ")
    if not len(centroids):
        types = [id_type, T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DecimalType(38, 0), T.StringType()]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in zip(result, types, strict=True)]))
    numbered = vectors.withColumn("key", F.monotonically_increasing_id()).repartition(n, "key")
    vectors, *_ = bucketed(numbered, "key", n)
    none = vectors.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("bigint")})
    state, *held = bucketed(_assign(none, centroids, np.arange(len(centroids)), id_type), "key", n)
    sums = np.zeros((len(centroids), dims + 1), object)
    for _ in range(rounds):
        for r in _total(state, dims):
            sums[r.cluster, r.place] += int(r.value)
        new = np.array([[int(v) // int(s[0]) for v in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids, strict=True)], np.int64)
        moved = np.flatnonzero((new != centroids).any(axis=1))
        if not len(moved):
            break
        centroids = new
        known = state.select("key", "owner", "distance").hint("shuffle_hash")
        after, *kept = bucketed(_assign(vectors.join(known, "key"), centroids, moved, id_type), "key", n)
        discard(spark, *held)
        state, held = after, kept
    inertia = {r.owner: r.s for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]  # one row for each cluster
    each = spark.createDataFrame(told, "owner int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    return state.join(F.broadcast(each), "owner").select("id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
