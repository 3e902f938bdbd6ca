"""Connected components of an edge table, by alternating stars.

Large-star and small-star steps halve the depth of the label trees, so the
number of rounds grows with the logarithm of a chain's length.  Each round is
written to the shared folder, and nothing is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stage


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(id, component) of every vertex on an edge; component is the smallest id reachable. Loops and repeated edges do no harm."""
    edges = stage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        # large star: neighbours above a vertex go to the smallest of its neighbours and itself
        near = _neighbours(edges)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: neighbours below a vertex and the vertex itself go to the smallest of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
        after = stage(small)
        # done when every vertex hangs on one centre that hangs on nothing
        moving = after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() or after.groupBy("v").count().filter("count > 1").limit(1).count()
        edges = after
        if not moving:
            break
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
