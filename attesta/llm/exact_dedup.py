"""Exact deduplication by progressive refinement.

Lengths are grouped first, then a hash of a short prefix within the lengths
that repeat, and only rows whose (length, prefix) repeats are grouped by the
SHA-256 of the whole text.  Every level aggregates with map-side combine, so a
group that holds a third of all rows shrinks before it is shuffled, and no text
ever enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import SPACES, small, stage

#: Code points of the normalised text that the second level hashes.
PREFIX = 64
#: Most repeated digests (about 150 bytes each) that are broadcast.
GROUPS = 150_000


def without_spaces(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=without_spaces, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their normalised forms are.  Of equal texts the one
    with the most code points before normalisation stays, then the smallest id;
    null ids come last.  ``text_sha256`` is filled for rows that reach the last
    level, and for all rows with ``digest_all``.  Rows that repeat an id share
    its decision.  An empty table gives an empty result; other columns of the
    input are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"), normalise(text).alias("norm"))
    keyed = stage(rows.select("id", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix")))

    lengths = keyed.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len")
    prefixes = keyed.join(lengths, "len", "left_semi").groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len", "prefix", F.lit(True).alias("deep"))
    prefixes = small(stage(prefixes))

    hashed = rows.select("id", "n_chars", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), "norm") if not digest_all else rows.select("id", "n_chars", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), F.sha2("norm", 256).alias("sha"))
    hashed = hashed.join(prefixes, ["len", "prefix"], "left").withColumn("deep", F.col("deep").isNotNull())
    if not digest_all:
        hashed = hashed.withColumn("sha", F.when(F.col("deep"), F.sha2("norm", 256)))
    hashed = stage(hashed.select("id", "n_chars", "deep", "sha"))

    best = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"))
    groups = hashed.filter("deep").groupBy("sha").agg(F.min(best).getField("c").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # repeated digests are few; beyond the bound both sides shuffle as they are, so that Spark can split a digest with very many rows
    groups = small(stage(groups), GROUPS)
    return hashed.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
