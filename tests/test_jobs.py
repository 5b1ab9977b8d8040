"""The job store against a plain state machine: batch, stream and files of states."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from factmill.operators import jobs
from factmill.sources import files
from factmill.streaming import jobs as streaming_jobs

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
LOG = "request_id string, provider_key string, seq long, kind string, ts timestamp, error string"
REQUESTS = "request_id string, ordinal int, providerId string, npi string, name string, ts timestamp"
KEYS = ["0:name:a", "1:name:b"]
DONE = {"completed", "no_results", "failed", "expired"}


def plain_job(created, events):
    """created: seconds or None. events: (seconds, seq, key, kind, error). The entry after all events."""
    job, end = None, None
    for at, _, key, kind, error in sorted([*events, *([(created, -1, None, "create", None)] if created is not None else [])], key=lambda e: (e[0], e[1])):
        live = job if job is not None and at < end else {"status": "expired"}
        if kind == "create":
            job = {"status": "queued", "jobs": {k: {"status": "queued", "startedAt": None, "completedAt": None, "error": None} for k in KEYS}}
        elif key is None:
            job = {"status": kind} | ({"error": error[:255]} if kind == "failed" else {})
        else:
            job = dict(live)
            job["jobs"] = {k: dict(v) for k, v in live.get("jobs", {}).items()}
            if key in job["jobs"]:
                job["jobs"][key] |= {"status": kind, "error": (error[:255] or None) if kind == "failed" else None, "startedAt" if kind == "searching" else "completedAt": at}
            held = [j["status"] for j in job["jobs"].values()]
            if held:
                job["status"] = "queued" if set(held) == {"queued"} else "running" if set(held) - DONE else "completed"
        end = at + (1800 if job["status"] == "completed" else 3600)
    held = None if job is None or "jobs" not in job else [j["status"] for j in job["jobs"].values()]
    counts = (None,) * 5 if held is None else (len(held), held.count("completed"), held.count("no_results"), held.count("failed"), sum(h not in DONE for h in held))
    return job["status"], *counts, job.get("error") or None, end


def random_log(seed, n=60):
    """Jobs whose events come seconds, half an hour, or an hour apart, to the second where an entry ends."""
    r = random.Random(seed)
    created, logs = {}, {}
    for i in range(n):
        at = r.randrange(0, 5000)
        created[f"r{i}"] = None if i % 13 == 0 else at
        events = []
        for seq in range(r.randrange(0, 14)):
            at += r.choice([0, 1, 60, 900, 1799, 1800, 1801, 2700, 3599, 3600, 3601, 9000])
            key = r.choice([None, *KEYS, *KEYS, "2:name:unknown"])
            kind = r.choice(["running", "completed", "failed"] if key is None else ["searching", "completed", "no_results", "failed"])
            events.append((at, seq, key, kind, r.choice(["", "e", "x" * 300]) if kind == "failed" else None))
        logs[f"r{i}"] = events
    return created, {k: v for k, v in logs.items() if v or created[k] is not None}


def frames(spark, created, logs):
    moment = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(k, key, seq, kind, moment(at), error) for k, events in logs.items() for at, seq, key, kind, error in events]
    random.Random(1).shuffle(rows)
    asked = [(k, i, None, None, name, moment(at)) for k, at in created.items() if at is not None and k in logs for i, name in enumerate("ab")]
    return spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(rows, LOG)


def flat(rows):
    base = T0.timestamp()
    return {r["request_id"]: (r["job_status"], r["total"], r["completed"], r["no_results"], r["failed"], r["running"], r["error"], int(r["expiresAt"].timestamp() - base)) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_plain_state_machine(spark, seed):
    created, logs = random_log(seed)
    got = flat(jobs.fold_jobs(*frames(spark, created, logs)).collect())
    assert got == {k: plain_job(created[k], events) for k, events in logs.items()}


def test_replay_of_the_cases_that_replace_a_job(spark):
    log = {
        "zeros": [(10, 1, None, "running", None), (20, 2, KEYS[0], "completed", None)],
        "failed": [(10, 1, None, "failed", "broken"), (20, 2, KEYS[0], "searching", None)],
        "expired": [(10, 1, KEYS[0], "searching", None), (10 + 3600, 2, KEYS[0], "completed", None)],
        "replaced": [(10, 1, KEYS[0], "searching", None), (20, 2, None, "completed", None)],
    }
    got = flat(jobs.fold_jobs(*frames(spark, dict.fromkeys(log, 0), log)).collect())
    assert got == {
        "zeros": ("running", 0, 0, 0, 0, 0, None, 3620),
        "failed": ("failed", 0, 0, 0, 0, 0, "broken", 3620),
        "expired": ("expired", 0, 0, 0, 0, 0, None, 7210),
        "replaced": ("completed", None, None, None, None, None, None, 1820),
    }


def test_what_a_hot_job_leaves_grows_with_time_not_with_events(spark):
    n = 40_000
    log = spark.range(n).select(F.lit("hot").alias("request_id"), F.lit(KEYS[0]).alias("provider_key"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "searching").otherwise("completed").alias("kind"), F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.floor(F.col("id") / 10)).alias("ts"), F.lit(None).cast("string").alias("error"))
    left = jobs.spans(log).collect()
    assert len(left) <= n / 10 / 1800 + 1 and all(len(x["patches"]) == 1 for x in left)
    requests = spark.createDataFrame([("hot", i, None, None, name, T0) for i, name in enumerate("ab")], REQUESTS)
    got = jobs.fold_jobs(requests, log).first()
    assert (got["completed"], got["running"], got["job_status"]) == (1, 1, "running")


def test_the_last_state_written_wins_and_ends_by_its_own_clock(spark, tmp_path):
    path = str(tmp_path / "jobs")
    state = lambda status, end: spark.createDataFrame([("a", status, T0 + dt.timedelta(seconds=end))], "request_id string, status string, expiresAt timestamp")
    files.write_jobs(state("running", 3600), path, 9)
    files.write_jobs(state("completed", 1860), path, 10)
    at = lambda seconds: [r["status"] for r in files.live_jobs(spark, path, T0 + dt.timedelta(seconds=seconds)).collect()]
    assert at(120) == ["completed"] and at(1859) == ["completed"]
    assert at(1860) == [] and at(3000) == []


def _streamed(spark, tmp_path, parts, delay):
    """The rows of each micro-batch, one for each list of events in parts."""
    source = tmp_path / "source"
    for i, rows in enumerate(parts):
        before = set(source.glob("*.parquet"))
        spark.createDataFrame(rows, LOG + ", providers array<string>").coalesce(1).write.mode("append").parquet(str(source))
        for f in set(source.glob("*.parquet")) - before:
            os.utime(f, (1e9 + i, 1e9 + i))  # files are taken in order of their time
    stream = spark.readStream.schema(LOG + ", providers array<string>").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = streaming_jobs.stream_jobs(stream, delay).writeStream.outputMode("update").foreachBatch(lambda df, i: got.append((i, df.collect()))).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return [rows for _, rows in sorted(got)]


def test_stream_equals_batch(spark, tmp_path):
    created, logs = random_log(5, 40)
    moment = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(k, key, seq, kind, moment(at), error, None) for k, events in logs.items() for at, seq, key, kind, error in events]
    rows += [(k, None, -1, "create", moment(at), None, KEYS) for k, at in created.items() if at is not None]
    r = random.Random(2)
    # Out of order by up to ten minutes.
    rows.sort(key=lambda x: x[4] + dt.timedelta(seconds=r.randrange(600)))
    cut = len(rows) // 4
    batches = _streamed(spark, tmp_path, [rows[i * cut : (i + 1) * cut if i < 3 else None] for i in range(4)], "1 hour")
    last, ended = {}, {}
    for found in batches:
        for x in found:
            (ended if x["ended"] else last)[x["request_id"]] = x
    expected = {k: plain_job(created[k], events) for k, events in logs.items()}
    assert flat(last.values()) == expected
    # Entries whose end the watermark has passed say so, each at the end that batch gives it.
    end = {k: v[-1] for k, v in expected.items()}
    latest = max(x[4] for x in rows).timestamp() - T0.timestamp() - 3600
    assert set(ended) == {k for k, e in end.items() if e <= latest}
    assert all(x["job_status"] == "expired" and x["total"] is None for x in ended.values())


def test_stream_drops_what_comes_after_the_delay(spark, tmp_path):
    event = lambda at, seq, kind, key=KEYS[0]: ("a", key, seq, kind, T0 + dt.timedelta(seconds=at), None, KEYS if kind == "create" else None)
    other = lambda at: ("b", None, 0, "running", T0 + dt.timedelta(seconds=at), None, None)
    parts = [[event(0, -1, "create", None), event(3000, 2, "searching")], [other(6000)], [event(4000, 3, "completed"), event(10, 1, "no_results", KEYS[1])]]
    batches = _streamed(spark, tmp_path, parts, "30 minutes")
    rows = [x for found in batches for x in found if x["request_id"] == "a" and not x["ended"]]
    # The event of second 10 is older than the watermark (6000 less 1800) by a whole span: its span is folded.
    assert (rows[-1]["completed"], rows[-1]["no_results"], rows[-1]["running"]) == (1, 0, 1)
