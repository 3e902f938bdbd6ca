"""Vectors of a table as vectors of whole numbers, and tables laid out by a key.

Not an operator: embedding whitening and centroid clustering both begin here.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.llm.common import column, shared_dir, tidy

#: Entries that one numpy step works on.
STEP = 1 << 21


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls, all of ``dims`` entries, as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def slices(batch: pa.RecordBatch, dims: int):
    """Parts of a batch of at most STEP entries of its vectors."""
    step = max(1, STEP // max(1, dims))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def long_rows(x: np.ndarray) -> pa.Array:
    """An int64 matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, shift: int = 0, limit: int = 1 << 52) -> DataFrame:
    """(id, x) of the vectors of exactly ``dims`` entries, x being floor(scale * entry) + shift.

    Null vectors, vectors of another length and vectors with an entry that is
    null, not finite or, multiplied, not below ``limit`` in size are left out.
    """

    @tidy
    def run(batches):
        for batch in batches:
            lists = column(batch, vector_col)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False))
            for part in slices(batch, dims):
                entries = column(part, vector_col).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(entries * scale)
                    ok = (np.abs(x) < limit).all(axis=1)  # false for NaN and infinity
                ids = column(part, id_col).filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([ids, long_rows(x[ok].astype(np.int64) + shift)], names=["id", "x"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.LongType()))])
    return df.select(id_col, vector_col).mapInArrow(run, schema)


def bucketed(df: DataFrame, key: str, n: int) -> tuple[DataFrame, str, str]:
    """The table written to the shared folder in ``n`` buckets of ``key``, so that joins on it need no shuffle; with its name and folder, for ``discard``."""
    spark, name, path = df.sparkSession, f"attesta_{uuid.uuid4().hex}", shared_dir(df.sparkSession)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name), name, path


def discard(spark, name: str, path: str) -> None:
    """Drops a bucketed table that nothing reads any more, and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
