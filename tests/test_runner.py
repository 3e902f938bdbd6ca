"""The job runner across restarts, against its own rules one request after the other."""

from datetime import datetime, timedelta

import pytest

from attesta.streaming import runner

DATA = "/root/testdata/sf0.001"


def brute(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.at, r.seq)):
        key = (r.job_type, r.identity)
        out[key] = runner.apply(out.get(key, (None, 0, 0, None, None)), r.kind, r.ok, r.detail, r.at)
    return {k: v for k, v in out.items() if v[0] is not None}


def states(spark, out):
    return {(r.job_type, r.identity): (r.status, r.attempts, r.skipped, r.error, r.completed_at) for r in runner.job_states(spark, out).collect()}


@pytest.mark.parametrize("files", [None, 1])
def test_restarted_halfway(spark, tmp_path, files):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    latest = events.orderBy("ts").limit(events.count() // 2).agg({"ts": "max"}).first()[0]
    first, second = events.filter(events.ts <= latest), events.filter(events.ts > latest)
    assert first.count() and second.count()
    first.coalesce(1).write.parquet(f"{log}/a")
    runner.run_jobs(spark, f"{log}/*", runner.event_requests, out, checkpoint, files)
    assert states(spark, out) == brute(runner.event_requests(first).collect())
    runner.run_jobs(spark, f"{log}/*", runner.event_requests, out, checkpoint, files)  # nothing new
    second.coalesce(1).write.parquet(f"{log}/b")
    runner.run_jobs(spark, f"{log}/*", runner.event_requests, out, checkpoint, files)
    assert states(spark, out) == brute(runner.event_requests(events).collect())


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("x", "1", t, 1, "run", False, "e" * 5000), ("x", "1", t + timedelta(1), 2, "run", True, None), ("x", "1", t + timedelta(2), 3, "run", True, None), ("x", "2", t, 4, "gate", False, "no key"), ("x", "2", t, 5, "retry", None, None), ("x", "3", t, 6, "retry", None, None)]
    schema = "job_type string, identity string, at timestamp, seq bigint, kind string, ok boolean, detail string"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(log)
    want = {("x", "1"): ("succeeded", 2, 1, None, t + timedelta(1)), ("x", "2"): ("queued", 0, 0, None, t)}
    for again in range(2):  # a lost checkpoint: the same batch comes a second time
        runner.run_jobs(spark, log, lambda d: d, out, str(tmp_path / f"c{again}"))
        assert states(spark, out) == want


def test_many_batches_without_python_workers(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    t, kinds = datetime(2024, 1, 1), (("run", False), ("gate", False), ("retry", None), ("run", True), ("run", None), ("gate", True))
    schema = "job_type string, identity string, at timestamp, seq bigint, kind string, ok boolean, detail string"
    rows = [("x" if i % 2 else None, str(i * i % 11), t + timedelta(hours=i), i, *kinds[i * 7 % 13 % 6], f"d{i}") for i in range(140)]
    for i in range(7):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.parquet(f"{log}/{i}")
        runner.run_jobs(spark, f"{log}/*", lambda d: d, out, checkpoint, 1)
        assert states(spark, out) == brute(spark.createDataFrame(rows[: 20 * i + 20], schema).collect())
    assert runner._folders(7) == [6, 5, 3] and runner._folders(8) == [7]
