"""A job runner over a log of requests: what each job's state is, kept by a stream.

Requests are runs with their outcome, retries and gates.  A stream applies them
to the state of each job in their order: a job that has succeeded is skipped,
any other run is an attempt more, a retry queues what has failed or is blocked,
and a gate blocks a job or lets it pass.  What a batch has changed is written
under the batch's number, so that a batch that is run again after a failure
replaces what it had written.  A batch's folder also holds what some batches
just before it have changed, so that the states before a batch are in as many
folders as its number has ones in binary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.session import shared_folder

#: Columns of a request: its job, its place in the log, what is asked (run, retry, gate) and, of runs and gates, how it went.
REQUEST = ["job_type", "identity", "at", "seq", "kind", "ok", "detail"]
_STATE = "status string, attempts bigint, skipped bigint, error string, completed_at timestamp"
_OUT = f"job_type string, identity string, {_STATE}"
#: Longest error text that is kept, a fixed value.
ERROR_TEXT = 4000


def apply(state: tuple, kind: str, ok: bool | None, detail: str | None, at) -> tuple:
    """(status, attempts, skipped, error, completed_at) after one request."""
    status, attempts, skipped, error, completed = state
    text = None if detail is None else detail[:ERROR_TEXT]
    if kind == "run":
        if status == "succeeded":
            return status, attempts, skipped + 1, error, completed
        return ("succeeded", attempts + 1, skipped, None, at) if ok else ("failed", attempts + 1, skipped, text, at)
    if kind == "gate":
        return ("succeeded", attempts, skipped, None, at) if ok else ("blocked", attempts, skipped, text, at)
    if kind == "retry" and status in ("failed", "blocked"):
        return "queued", attempts, skipped, None, completed
    return state


def _applied(state: Column, r: Column) -> Column:
    """As ``apply``, on columns."""
    names = ("status", "attempts", "skipped", "error", "completed_at")
    status, attempts, skipped, error, completed = (state[n] for n in names)
    none, text = F.lit(None).cast("string"), F.substring(r["detail"], 1, ERROR_TEXT)
    ok, run, gate = F.coalesce(r["ok"], F.lit(False)), r["kind"] == "run", r["kind"] == "gate"
    new = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    return (
        F.when(run & F.coalesce(status == "succeeded", F.lit(False)), new(status, attempts, skipped + 1, error, completed))
        .when(run & ok, new(F.lit("succeeded"), attempts + 1, skipped, none, r["at"]))
        .when(run, new(F.lit("failed"), attempts + 1, skipped, text, r["at"]))
        .when(gate & ok, new(F.lit("succeeded"), attempts, skipped, none, r["at"]))
        .when(gate, new(F.lit("blocked"), attempts, skipped, text, r["at"]))
        .when((r["kind"] == "retry") & status.isin("failed", "blocked"), new(F.lit("queued"), attempts, skipped, none, completed))
        .otherwise(state)
    )


def _folders(n: int) -> list[int]:
    """The folders that hold the states after the first n batches: folder m - 1 has those of as many batches as the lowest one of m in binary says."""
    return [n - 1, *_folders(n & (n - 1))] if n else []


def run_jobs(spark: SparkSession, source: str, requests: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int | None = None) -> None:
    """Apply the log files of ``source`` that the checkpoint has not seen; ``requests`` gives their REQUEST columns.

    Requests of a batch are put in the order of (at, seq) for each job, and
    batches follow each other, so the log's files have to grow with time.
    ``files`` at once bound what a task holds: a batch's requests of one job.
    """
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    struct = "struct<status: string, attempts: bigint, skipped: bigint, error: string, completed_at: timestamp>"

    def put(batch: DataFrame, n: int) -> None:
        own = F.struct(F.col("at").isNull(), "at", "seq", "kind", "ok", "detail").alias("r")
        rows = batch.select("job_type", "identity", own, F.lit(None).cast("int").alias("batch"), F.lit(None).cast(struct).alias("s"))
        if n:
            before = batch.sparkSession.read.schema(f"{_OUT}, batch int").parquet(*[f"{out}/run-{i:09d}" for i in _folders(n)])
            state = F.struct("status", "attempts", "skipped", "error", "completed_at").cast(struct).alias("s")
            rows = rows.unionByName(before.select("job_type", "identity", F.lit(None).cast(rows.schema["r"].dataType).alias("r"), "batch", state))
        jobs = rows.groupBy("job_type", "identity").agg(F.array_sort(F.collect_list("r")).alias("r"), F.max_by("s", "batch").alias("s"), F.max("batch").alias("batch"))
        start = F.coalesce("s", F.struct(F.lit(None).alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("skipped"), F.lit(None).alias("error"), F.lit(None).alias("completed_at")).cast(struct))
        after = jobs.select("job_type", "identity", F.aggregate("r", start, lambda s, r: _applied(s, r).cast(struct)).alias("s"), F.when(F.size("r") > 0, F.lit(n)).otherwise(F.col("batch")).alias("batch"))
        held = after.filter((F.col("batch") >= (n & (n + 1))) & F.col("s.status").isNotNull())
        held.select("job_type", "identity", "s.*", "batch").write.mode("overwrite").parquet(f"{out}/run-{n:09d}")

    requests(stream).select(*REQUEST).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def job_states(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of each job."""
    rows = spark.read.option("recursiveFileLookup", True).schema(f"{_OUT}, batch int").parquet(out)
    names = ["status", "attempts", "skipped", "error", "completed_at"]
    return rows.groupBy("job_type", "identity").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("job_type", "identity", "s.*")


#: What an event of the log asks of a job: kind, whether it goes well.
_KINDS = {"purchase": ("run", True), "error": ("run", False), "view": ("retry", None), "click": ("gate", False), "signup": ("gate", True)}


def event_requests(events: DataFrame) -> DataFrame:
    """Events as requests: eight types of jobs for each user."""
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v[i])) for k, v in _KINDS.items() if v[i] is not None])
    job = F.concat(F.lit("type-"), (F.col("event_id") % 8).cast("string")).alias("job_type")
    return events.select(job, F.col("user_id").cast("string").alias("identity"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), pick(0).alias("kind"), pick(1).alias("ok"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("detail"))


def job_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all jobs after the whole log."""
    out, checkpoint = (f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("jobs", "stream"))
    run_jobs(spark, f"{sf_dir}/events.parquet*", event_requests, out, checkpoint)
    return job_states(spark, out)


QUERIES = {"job_runner": job_runner}
ORACLES = {
    "job_runner": """WITH RECURSIVE e AS (SELECT 'type-' || event_id % 8 AS job_type, user_id::VARCHAR AS identity, event_type AS t, event_type || ' ' || event_id AS detail, ts, row_number() OVER (PARTITION BY user_id, event_id % 8 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT job_type, identity, 0 AS n, NULL::VARCHAR AS status, 0 AS attempts, 0 AS skipped, NULL::VARCHAR AS error, NULL::TIMESTAMP AS completed_at FROM e WHERE n = 1
UNION ALL SELECT r.job_type, r.identity, e.n,
 CASE WHEN t IN ('purchase', 'signup') THEN 'succeeded' WHEN t = 'error' THEN CASE WHEN status = 'succeeded' THEN status ELSE 'failed' END WHEN t = 'click' THEN 'blocked' WHEN status IN ('failed', 'blocked') THEN 'queued' ELSE status END,
 attempts + (t IN ('purchase', 'error') AND status IS DISTINCT FROM 'succeeded')::INT, skipped + (t IN ('purchase', 'error') AND status IS NOT DISTINCT FROM 'succeeded')::INT,
 CASE WHEN t = 'click' OR (t = 'error' AND status IS DISTINCT FROM 'succeeded') THEN detail WHEN t = 'view' AND (status IS NULL OR status NOT IN ('failed', 'blocked')) THEN error END,
 CASE WHEN t = 'view' OR (t IN ('purchase', 'error') AND status IS NOT DISTINCT FROM 'succeeded') THEN completed_at ELSE e.ts END
FROM r JOIN e ON e.job_type = r.job_type AND e.identity = r.identity AND e.n = r.n + 1)
SELECT job_type, identity, status, attempts::BIGINT AS attempts, skipped::BIGINT AS skipped, error, completed_at FROM (SELECT *, row_number() OVER (PARTITION BY job_type, identity ORDER BY n DESC) AS k FROM r) WHERE k = 1 AND status IS NOT NULL"""
}
