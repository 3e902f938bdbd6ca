"""Keyed merges: what an upsert does to a table, stated over whole tables.

A Parquet table is not changed in place; a merge is the union of the stored and
the new rows, reduced by key.  Every policy is one aggregation with map-side
combine: no window, so a key with very many versions does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What becomes of a column when a key is met again.
OVERWRITE, NEW_UNLESS_NULL, OLD_UNLESS_NULL, FROZEN = "overwrite", "new_unless_null", "old_unless_null", "frozen"


def _pick(col: str, policy: str, order: list[Column]) -> Column:
    # the value is boxed, so that a null that wins stays one
    box, seq = F.struct(F.col(col).alias("v")), F.struct(*order)
    known = F.col(col).isNotNull()
    return {
        OVERWRITE: F.max_by(box, seq).getField("v"),
        FROZEN: F.min_by(box, seq).getField("v"),
        NEW_UNLESS_NULL: F.max_by(F.col(col), F.when(known, seq)),
        OLD_UNLESS_NULL: F.min_by(F.col(col), F.when(known, seq)),
    }[policy].alias(col)


def merge(rows: DataFrame, key: list[str], order: list[str], policies: dict[str, str], default: str = OVERWRITE) -> DataFrame:
    """One row per key from all versions, the earliest first by ``order``; columns follow their policies.

    Rows with a null in the key are one key of their own.  ``order`` should be
    total within a key, else equal versions are decided by chance.
    """
    seq = [F.col(c) for c in order]
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(*[_pick(c, policies.get(c, default), seq) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], policies: dict[str, str] | None = None, default: str = OVERWRITE, order: str | None = None) -> DataFrame:
    """The table after ``new`` was merged into ``old``, in the order of ``order`` within ``new``."""
    at = (lambda d, k: d.withColumn("__src", F.lit(k)).withColumn("__seq", F.col(order) if order and k else F.lit(0)))
    both = at(old, 0).unionByName(at(new, 1), allowMissingColumns=True)
    return merge(both, key, ["__src", "__seq"], policies or {}, default).select(old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` and the first of the new rows for each key that it lacks."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*fresh.columns), F.col(order)).alias("r")).select("r.*")
    return old.unionByName(first.select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """Children of the parents that occur in ``new`` are replaced by those in ``new``."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new.select(old.columns))


def update_where(table: DataFrame, changes: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Columns of the rows that ``changes`` names by key are set to its values (null too)."""
    c = changes.select(*key, F.struct(*cols).alias("__new"))
    out = table.join(c, key, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{x}")).otherwise(F.col(x)).alias(x) if x in cols else F.col(x) for x in table.columns])


def publish(df: DataFrame, path: str, check: DataFrame | None = None) -> None:
    """Write a whole table in one commit, after a check that must have no rows."""
    if check is not None and (bad := check.limit(1).collect()):
        raise ValueError(f"not published: {bad[0].asDict()}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
