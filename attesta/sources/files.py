"""Readers of released files: tables in ZIPs, JSON lines and envelopes, CSV of unknown dialect, SQLite and manifests.

Files are listed by Spark and opened where they lie (``streams``), or else read
by Spark, so they may be in any store it knows.  A ZIP file is one task's work,
as its format cannot be split; its rows leave the task in batches.  Tables of a
mounted SQLite file are read in ranges of row ids.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.scalars import canonical_json, clean
from attesta.sources import streams

#: Rows of a batch that a file's reader gives out.
ROWS = 5000
#: Keys under which an envelope may hold its list, fixed values, in order.
ENVELOPE = ("data", "items", "results", "records", "medicines")
_ROW = T.StructType([T.StructField("seq", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
_ARROW = pa.schema([("seq", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])


def _batches(rows):
    some = []
    for i, r in enumerate(rows):
        some.append({"seq": i, "fields": list(r.items())})
        if len(some) == ROWS:
            yield pa.RecordBatch.from_pylist(some, _ARROW)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, _ARROW)


def _columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("seq", *[F.col("fields").getItem(c).alias(c) for c in columns])


def zip_table(spark: SparkSession, path: str, suffix: str, columns: list[str], sep: str = "\t", optional: bool = False) -> DataFrame:
    """Rows of the member with the shortest name that ends with ``suffix`` in any case: seq and the named columns, as text.

    A byte order mark is skipped, bad bytes are replaced, and missing columns are null.  Without such a member: an error, or no rows if ``optional``.
    """

    def run(file, uri):
        with zipfile.ZipFile(file) as z:
            names = sorted((n for n in z.namelist() if n.casefold().endswith(suffix.casefold())), key=lambda n: (len(n), n))
            if not names:
                if optional:
                    return
                raise ValueError(f"no member ends with {suffix}")
            with z.open(names[0]) as f:
                reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline=""), delimiter=sep)
                yield from _batches({k.strip(): v for k, v in r.items() if k is not None and isinstance(v, str)} for r in reader)

    return _columns(streams.each_file(spark, path, run, _ROW), columns)


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a table of an SQLite file as text; an error if one of the required tables is missing.

    A mounted file is read in ranges of row ids.  One in another store is a
    task's work and ends at 2 GB, as SQLite cannot read it in pieces.
    """
    if streams.local(path):
        return streams.sqlite_ranges(spark, path, table, columns, required)

    def run(file, uri):
        import sqlite3

        db = sqlite3.connect(":memory:")
        db.deserialize(file.read())
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        if lacking := sorted({table, *required} - have):
            raise ValueError(f"tables are missing: {', '.join(lacking)}")
        names = ", ".join(f'"{c}"' for c in columns)
        rows = db.execute(f'SELECT {names} FROM "{table}"')
        yield from _batches({c: None if v is None else str(v) for c, v in zip(columns, r, strict=True)} for r in rows)
        db.close()

    return _columns(streams.each_file(spark, path, run, _ROW), columns).drop("seq")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): lines that are not blank; ``split`` is where in the file its piece begins, ``at`` ascends by one within a piece."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    return read.filter(clean(F.col("value")).isNotNull()).withColumn("at", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines that are not blank, numbered from 1 in each file.

    Pieces of a file are read apart: their lines are counted first, a row for
    each piece, and sums of these counts give every piece its first number.
    """
    found = lines(spark, path)
    pieces = found.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "split", "first", "before")
    return found.join(pieces, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, check: bool = True) -> DataFrame:
    """Objects of files of JSON lines, blank lines skipped.

    A line that is not a JSON object of the schema is an error.  With ``check``
    the files are gone over at once, and the ValueError names the first one as
    ``file:line``, blank lines not counted; without, reading the rows fails and
    tells file and text.
    """
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines(spark, path).withColumn("r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    wrong = F.col("r._bad").isNotNull()
    if check and (bad := parsed.filter(wrong).select("file", "split", "at", "value").orderBy("file", "split", "at").first()):
        # only now lines are counted: those of the file's earlier pieces, and of its own those before
        same = lines(spark, path).filter(F.col("file") == bad.file)
        n = same.filter((F.col("split") < bad.split) | ((F.col("split") == bad.split) & (F.col("at") <= bad.at))).count()
        raise ValueError(f"invalid JSON line {bad.file}:{n}: {bad.value[:200]}")
    error = F.raise_error(F.concat(F.lit("invalid JSON line in "), "file", F.lit(": "), F.substring("value", 1, 200))).cast(whole)
    checked = parsed.withColumn("r", F.when(wrong, error).otherwise(F.col("r")))
    return checked.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def json_envelope(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSON file that is a list, or an object with a list under one of the known keys."""

    def run(file, uri):
        found = json.loads(file.read().decode("utf-8-sig"))
        if isinstance(found, dict):
            found = next((found[k] for k in ENVELOPE if isinstance(found.get(k), list)), None)
        if not isinstance(found, list):
            raise ValueError("the file holds no list of records")
        for i in range(0, len(found), ROWS):
            yield pa.RecordBatch.from_pydict({"value": [json.dumps(x, ensure_ascii=False) for x in found[i : i + ROWS]]}, pa.schema([("value", pa.string())]))

    return streams.each_file(spark, path, run, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header and comma, tab or semicolon between its columns, all of them text.

    It is read in pieces, unless a quoted value holds a line break (a line then
    has an odd number of quotation marks).
    """
    lines = spark.read.text(path)
    head = "\n".join(r.value for r in lines.limit(400).collect())[: 16 << 10]
    try:
        sep = csv.Sniffer().sniff(head, ",\t;").delimiter
    except csv.Error:
        sep = "\t" if path.endswith((".tsv", ".txt")) else ","
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not lines.filter(quotes % 2 == 1).isEmpty()
    return spark.read.option("header", True).option("multiLine", broken).option("escape", '"').csv(path, sep=sep)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of all files below a folder."""
    return streams.digests(spark, path)


def changed_artifacts(registered: DataFrame, found: DataFrame) -> DataFrame:
    """Files that a release holds under the same path with other bytes: a release does not change."""
    old = registered.select("release_id", "path", F.col("size_bytes").alias("old_size"), F.col("sha256").alias("old_sha256"))
    return found.join(old, ["release_id", "path"]).filter((F.col("size_bytes") != F.col("old_size")) | (F.col("sha256") != F.col("old_sha256")))


def write_sorted(df: DataFrame, path: str, *by: str) -> None:
    """Parquet with zstd, rows sorted within files by ranges of the keys."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str, *names: str) -> None:
    """JSON lines with keys in order, in one commit of Spark's writer."""
    df.select(canonical_json(df, *(names or df.columns)).alias("value")).write.mode("overwrite").text(path)


def output_report(spark: SparkSession, path: str) -> DataFrame:
    """One row on a written folder: files, bytes and the SHA-256 of the sorted digests of its files."""
    files = manifest(spark, path).filter(F.col("path").rlike("/part-[^/]*$"))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))


def unfetched(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a fetch that was interrupted has still to bring: wanted keys without a row in the partial output, each once."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def ocr_results(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Results of text recognition (``*/result.json`` with publication, status, text and pages) as jobs to review: an error without text makes a failed job, and an unknown publication a rejected one.  Nothing is accepted by it."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("publication", T.StringType()), ("status", T.StringType()), ("text", T.StringType()), ("pages", T.ArrayType(T.StringType())))])
    found = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "result.json").option("recursiveFileLookup", True).json(path)
    text = F.coalesce(clean(F.col("text")), F.nullif(F.array_join("pages", "\n\n"), F.lit("")))
    known = documents.select("publication", F.lit(True).alias("known")).distinct()
    state = F.when(F.col("known").isNull(), "rejected").when((F.col("status") != "ok") | F.col("text").isNull(), "failed").otherwise("needs_review")
    out = found.withColumn("text", text).join(known, "publication", "left")
    return out.select("publication", state.alias("review_status"), "text", F.sha2("text", 256).alias("text_sha256"), F.size(F.coalesce("pages", F.array().cast("array<string>"))).alias("n_pages"))
