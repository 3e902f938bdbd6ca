"""The shared folder of a session, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of narrow tables that are broadcast; beyond it joins shuffle.
FEW = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. In local mode (tests, one machine) a temporary one is set where none is named; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(base)
    return str(base).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet files in the shared folder: it is computed once, and Spark knows its size."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """The (narrow, written) table with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
