"""Whitening of embeddings by a covariance in two passes.

Entries become whole numbers, and the model is fitted on the distinct vectors.
The first pass sums every dimension exactly, which gives the mean as a quotient
and a remainder; the second centres the vectors on it and sums their outer
products, a matrix product for each batch, merged as a tree.  The symmetric
matrix, as wide as a vector is long, is decomposed on the driver by LAPACK, and
the projection is sent to all tasks, which go over the rows once more.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import column, stage, tidy
from attesta.llm.vectors import matrix, slices, whole_vectors


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with exact sums; eigenvalues falling, eigenvectors as columns, the trace, and how far whitened rows are from uncorrelated."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What is left of the sums after ``whole`` times n."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def has_variance(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > self.trace * len(self.sums) * 4 * np.finfo(float).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components; NaN on those without variance."""
        ok = self.has_variance()
        return self.centred(x) @ (self.vectors / np.sqrt(np.where(ok, self.values, np.nan)))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2 of each row, exact at any size."""
        far = max((abs(int(v)) for v in ((x - self.whole).min(initial=0), (x - self.whole).max(initial=0))), default=0)
        if self.n * (far + 1) >= 1 << 50 or x.shape[1] > 1024:
            return [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        v = (x - self.whole) * self.n - self.rest
        a, b = v >> 24, v & 0xFFFFFF
        parts = zip((a * a).sum(axis=1).tolist(), (a * b).sum(axis=1).tolist(), (b * b).sum(axis=1).tolist(), strict=True)
        return [(p << 48) + (q << 25) + r for p, q, r in parts]


def _sums(vectors: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are and their exact sums in every dimension, a row for each through the driver."""

    @tidy
    def run(batches):
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            for part in slices(batch, dims):
                x = matrix(column(part, "x"), dims)
                # two halves, so that no sum leaves 64 bits
                total += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["dim", "value"])

    found = vectors.select("x").mapInArrow(run, "dim int, value string").groupBy("dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = {r.dim: int(r.value) for r in found.collect()}
    return sums.get(-1, 0), tuple(sums.get(i, 0) for i in range(dims))


def _add(a, b):
    return b if a is None else a if b is None else a + b


def _outer(vectors: DataFrame, mean: Whitening, dims: int) -> np.ndarray:
    """Sum of the outer products of the centred vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(mean)

    @tidy
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            for part in slices(batch, dims):
                c = sent.value.centred(matrix(column(part, "x"), dims))
                total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = vectors.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(dims, dims))
    return parts.treeAggregate(None, _add, _add)


def _merge(a, b):
    """Count, mean and centred products of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _identity_error(vectors: DataFrame, model: Whitening, dims: int) -> float | None:
    """Largest entry of the covariance of whitened vectors less the identity, components without variance left out; None if all are."""
    ok = model.has_variance()
    if not ok.any():
        return None
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        total = None
        for batch in batches:
            for part in slices(batch, dims):
                w = sent.value.whitened(matrix(column(part, "x"), dims))[:, ok]
                mean = w.mean(axis=0)
                total = _merge(total, (len(w), mean, (w - mean).T @ (w - mean)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], names=["n", "mean", "part"])

    k = int(ok.sum())
    parts = vectors.select("x").mapInArrow(run, "n bigint, mean binary, part binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1]), np.frombuffer(r[2]).reshape(k, k)))
    n, _, total = parts.treeAggregate(None, _merge, _merge)
    return float(np.abs(total / n - np.eye(k)).max())


def length_of(df: DataFrame, vector_col: str) -> int:
    """The length that most vectors have, of equals the greater; 0 if there is none."""
    found = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def fit(vectors: DataFrame, dims: int, components: int = 16) -> Whitening | None:
    """The model of the distinct vectors x of a table; None if there are none."""
    vectors = stage(vectors.select("x").distinct())
    n, sums = _sums(vectors, dims)
    if not n:
        return None
    nothing = np.zeros(0)
    covariance = _outer(vectors, Whitening(n, sums, nothing, nothing, 0.0), dims) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    model = Whitening(n, sums, values[::-1][:components].copy(), axes[:, ::-1][:, :components].copy(), trace)
    return Whitening(n, sums, model.values, model.vectors, trace, _identity_error(vectors, model, dims))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000, dims: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for every kept vector and each of the first ``components``.

    Kept are vectors without null or non-finite entries, of ``dims`` entries
    (None: the length that most vectors have); an entry c counts as x =
    floor(scale * c) + shift, and a vector with an entry of 2^52 / scale or more
    is left out.  The model is that of the distinct x; repeated rows and null ids
    get their rows all the same.  ``deviation`` is a decimal, null where it has
    more than 38 digits.  A component without variance (fewer distinct vectors
    than entries, a constant entry) has a null ``whitened`` and explains nothing;
    if none has any, ``explained`` is 0 and ``identity_error`` null.  An empty
    table gives an empty result; other columns are left behind and may have any
    name.  The driver holds a matrix of dims x dims numbers.
    """
    dims = length_of(df, vector_col) if dims is None else dims
    x = whole_vectors(df, id_col, vector_col, dims, scale, shift)
    fields = [("id", df.schema[id_col].dataType), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    model = fit(x, dims, components) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        model = sent.value
        k, most = len(model.values), 10**38
        explained = np.where(model.has_variance(), model.values, 0) / model.trace if model.trace > 0 else np.zeros(k)
        for batch in batches:
            for part in slices(batch, 4 * dims):
                rows = matrix(column(part, "x"), dims)
                m = len(rows)
                each = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array([Decimal(d) if d < most else None for d in model.deviations(rows)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        deviation.take(each),
                        pa.array(model.whitened(rows).ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m)),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    names=schema.names,
                )

    return x.mapInArrow(run, schema)
