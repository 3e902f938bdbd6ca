"""Releases of several tables that are seen at once or not at all.

A release is a folder of tables and a manifest.  Tables are written and checked
first; the manifest, which names their folders, is written last under the next
number.  Readers take the last manifest that is complete, so they see the old
tables until all new ones are there.  Two writers cannot take one number: the
second fails.  Folders of releases that were not published hold no manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published releases, ascending."""
    fs, folder = _files(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.isdigit() and fs.exists(_files(spark, f"{root}/manifests/{n}/_SUCCESS")[1])]
    return sorted(map(int, done))


def tables_of(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Folders of the tables of a release (the last one if no number is given); ValueError if there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no release {'' if version is None else version} in {root}")
    rows = spark.read.schema("table_name string, folder string").parquet(f"{root}/manifests/{known[-1] if version is None else version:09d}")
    return {r.table_name: r.folder for r in rows.collect()}


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a release; ValueError if the release has none of that name."""
    folders = tables_of(spark, root, version)
    if table not in folders:
        raise ValueError(f"no table {table} in {root}")
    return spark.read.parquet(f"{root}/{folders[table]}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks=None) -> int:
    """Write all tables, check them and publish them as one release; gives its number.

    ``checks`` takes the written tables by name and gives tables of faults by
    name; a fault in any of them is a ValueError that shows one, and the last
    release stays what it was.  Tables of the last release that are not given
    stay in the new one; a table may be made from its own last release.
    """
    before = tables_of(spark, root) if versions(spark, root) else {}
    number, stamp, folders = (versions(spark, root) or [0])[-1] + 1, uuid.uuid4().hex[:12], dict(before)
    written = {}
    for name, df in tables.items():
        folders[name] = f"data/{number:09d}-{stamp}/{name}"
        df.write.option("compression", "zstd").parquet(f"{root}/{folders[name]}")
        written[name] = spark.read.parquet(f"{root}/{folders[name]}")
    for name, bad in (checks(written) if checks else {}).items():
        if first := bad.first():
            raise ValueError(f"not published: {name}: {first.asDict()}")
    rows = spark.createDataFrame(sorted(folders.items()), "table_name string, folder string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/{number:09d}")
    return number
