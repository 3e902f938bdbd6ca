"""Large files of a release: opened where they lie and read piece by piece.

Spark lists the files and deals them to tasks.  A task opens a file itself if
its store is mounted on all machines or one that pyarrow knows, and never holds
it whole; files of other stores come through Spark's reader as one cell, which
ends at 2 GB.
"""

from __future__ import annotations

import hashlib
import re
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that are held at once.
CHUNK = 8 << 20
#: Rows of a batch.
ROWS = 5000


def local(uri: str) -> str | None:
    """Path of a mounted file; None for one in another store."""
    return re.sub("^file:/*", "/", uri) if uri.startswith(("file:", "/")) else None


def open_file(uri: str):
    """A binary file to read from, seek included."""
    if path := local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _opens(uri: str) -> bool:
    if local(uri):
        return True
    try:
        from pyarrow import fs

        fs.FileSystem.from_uri(uri)
    except (OSError, pa.ArrowException):
        return False
    return True


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a path, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def each_file(spark: SparkSession, path: str, run: Callable[[object, str], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Batches that ``run`` makes of every file below a path, given as an open file and its name; files are dealt out one by one."""
    files = listing(spark, path)
    first = files.first()
    if first and _opens(first.path):

        def opened(batches):
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    with open_file(uri) as f:
                        yield from run(f, uri)

        n = max(1, files.count())
        return files.repartitionByRange(n, "path").select("path").mapInArrow(opened, schema)

    def held(batches):
        import io

        for batch in batches:
            for uri, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from run(io.BytesIO(content), uri)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(held, schema)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a path, of any size."""

    def run(f, uri):
        digest, size = hashlib.sha256(), 0
        while chunk := f.read(CHUNK):
            digest.update(chunk)
            size += len(chunk)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([digest.hexdigest()])], names=["path", "size_bytes", "sha256"])

    return each_file(spark, path, run, "path string, size_bytes bigint, sha256 string")


class Rows(InputPartition):
    """Rows of an SQLite table from one rowid to another; without bounds all of them."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


def _connect(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("numpartitions", "8"))
        self.required = [t for t in options.get("required", "").split(",") if t]

    def partitions(self):
        db = _connect(self.path)
        have = dict(db.execute("SELECT name, sql FROM sqlite_master WHERE type IN ('table', 'view')"))
        if lacking := sorted({self.table, *self.required} - set(have)):
            raise ValueError(f"tables are missing: {', '.join(lacking)}")
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        except sqlite3.OperationalError:  # a view, or a table without row ids
            return [Rows(None, None)]
        finally:
            db.close()
        if not isinstance(low, int):
            return [Rows(None, None)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        db = _connect(self.path)
        names = ", ".join(f'"{c}"' for c in self.columns)
        where = "" if partition.low is None else f" WHERE rowid BETWEEN {partition.low} AND {partition.high} ORDER BY rowid"
        rows = db.execute(f'SELECT {names} FROM "{self.table}"{where}')
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        while some := rows.fetchmany(ROWS):
            cols = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in c], pa.string()) for c in cols], schema=schema)
        db.close()


class SqliteSource(DataSource):
    """Columns of a table of a mounted SQLite file as text, in ranges of row ids. Options: path, table, required (names with commas), numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "attesta_sqlite"

    def schema(self) -> str:
        raise ValueError("name the columns as a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def sqlite_ranges(spark: SparkSession, path: str, table: str, columns: list[str], required: tuple[str, ...] = (), parts: int = 8) -> DataFrame:
    """Columns of a table of a mounted SQLite file as text, read by ``parts`` tasks; of a view, or a table without row ids, by one."""
    spark.dataSource.register(SqliteSource)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("attesta_sqlite").schema(schema).option("path", local(path)).option("table", table).option("required", ",".join(required)).option("numPartitions", str(parts)).load()
