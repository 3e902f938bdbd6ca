"""Job logs read as a stream of files: new files are picked up once, then the query ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.session import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def consume(spark: SparkSession, source: str, transform, out: str, checkpoint: str) -> None:
    """Run ``transform`` over the files of ``source`` that the checkpoint has not seen, and append its rows to ``out``.

    A second call with the same checkpoint reads new files only.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    q = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def once(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Each key once within the watermark's delay: the same job announced again is skipped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def stream_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour, counted by a stream that reads every file of the log once."""
    out, checkpoint = _folder(spark), _folder(spark)

    def transform(stream: DataFrame) -> DataFrame:
        return stream.select("event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))

    # a log may be one file or a folder of files
    consume(spark, f"{sf_dir}/events.parquet*", transform, out, checkpoint)
    return spark.read.parquet(out).groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"stream_job_counts": stream_job_counts}
ORACLES = {"stream_job_counts": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL"}
