"""Best rows per key, staged look-ups and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top1(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. ``order`` has to end with something unique.

    Spark limits the groups in every partition before it shuffles them, so a
    key with very many rows costs one row from each partition.
    """
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def left_join_top1(left: DataFrame, right: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first row of each key."""
    return left.join(top1(right, key, order), key, "left")


def first_stage(candidates: DataFrame, key: list[str], stage: str, tie: list[Column]) -> DataFrame:
    """Of candidates from several stages, those of the first stage that has any, and of them the first by ``tie``."""
    return top1(candidates, key, [F.col(stage).asc(), *tie])


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, rate_at: str, value: str, row_id: list[str], width: float | None = None) -> DataFrame:
    """Rows of ``left`` with the value of ``right`` at the latest ``rate_at`` that is not after ``at``; rows without one go.

    Both sides are put in one sequence per key and the last rate carried
    forward, so the work grows with the rows and not with pairs of them.  With
    ``width`` (seconds) a key is cut into ranges of that length: the last rate
    of the ranges before is carried into each by a small aggregate, so a key
    with very many rows is many tasks' work.
    """
    cell = F.lit(0) if width is None else F.floor(F.col("__t").cast("timestamp").cast("double") / width)
    a = left.select(*[F.col(k) for k in key], F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    b = right.select(*[F.col(k) for k in key], F.col(rate_at).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.unionByName(b).withColumn("__cell", cell)
    w = W.partitionBy(*key, "__cell").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(w))
    if width is not None:
        before = W.partitionBy(*key).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
        last = both.groupBy(*key, "__cell").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__last"))
        carried = last.select(*key, "__cell", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
        seen = seen.filter("__side = 1").join(carried, [*key, "__cell"]).withColumn("__seen", F.coalesce("__seen", "__carry"))
    return seen.filter("__side = 1 and __seen is not null").select("__row.*", F.col("__seen").alias(value))


def recent(rows: DataFrame, stamps: list[str], tie: str, limit: int = 25) -> DataFrame:
    """The latest rows by the first of several time stamps that is there; a page of a report."""
    return rows.withColumn("latest", F.coalesce(*stamps)).orderBy(F.col("latest").desc_nulls_last(), F.col(tie)).limit(limit)


def ranked(col: str, *values: str) -> Column:
    """Place of a value in a stated order; others come last."""
    return F.coalesce(*[F.when(F.col(col) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))
