"""The job store over a stream of events: state by request that ends by its own clock."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factmill.operators.jobs import JOB_EVENTS, JOB_TTL, MOST_ERROR, PROVIDER_EVENTS, RESULT_TTL, TERMINAL

OUT = "request_id string, job_status string, total long, completed long, no_results long, failed long, running long, error string, expiresAt timestamp, ended boolean"
HELD = "job string, spans string, upto long"
SPAN = RESULT_TTL * 1_000_000


def _cut(error: str | None) -> str | None:
    """The first MOST_ERROR UTF-16 units, as text.left_units cuts."""
    return (error or "").encode("utf-16-be")[: 2 * MOST_ERROR].decode("utf-16-be", "replace") or None


def _take(spans: dict[str, dict], at: list[int], key: str | None, kind: str, error: str | None, providers: list[str] | None) -> None:
    """Adds one event to what is known of its span; events may come in any order."""
    span = spans.setdefault(str(at[0] // SPAN), {"first": at[0], "last": at, "reset": None, "patches": {}})
    span["first"], span["last"] = min(span["first"], at[0]), max(span["last"], at)
    if key is None:
        if span["reset"] is None or at > span["reset"]["at"]:
            span["reset"] = {"at": at, "kind": kind, "error": error, "providers": providers or []}
        return
    patch = span["patches"].setdefault(key, {"at": None, "startedAt": None, "completedAt": None})
    field = PROVIDER_EVENTS[kind]
    patch[field] = max(patch[field] or at, at)
    if patch["at"] is None or at > patch["at"]:
        patch |= {"at": at, "kind": kind, "error": error}


def _after_span(job: dict | None, span: dict) -> dict:
    """A job after the events of one span, in which it can't end."""
    reset = span["reset"]
    if reset is not None:
        listed = {k: {"status": "queued", "error": None, "startedAt": None, "completedAt": None} for k in reset["providers"]} if reset["kind"] == "create" else None
        job = {"status": "queued" if listed is not None else reset["kind"], "providers": listed, "error": _cut(reset["error"]) if reset["kind"] == "failed" else None}
    elif job is None or span["first"] >= job["ends"]:
        job = {"status": "expired", "providers": None, "error": None}
    since = [-1] if reset is None else reset["at"]
    patches = {k: p for k, p in span["patches"].items() if p["at"] > since}
    if patches:
        held = dict(job["providers"] or {})
        for key in patches.keys() & held.keys():
            p = patches[key]
            held[key] = held[key] | {"status": p["kind"], "error": _cut(p["error"]) if p["kind"] == "failed" else None} | {f: p[f][0] for f in ("startedAt", "completedAt") if p[f] is not None and p[f] > since}
        job = job | {"providers": held}
    states = [p["status"] for p in (job["providers"] or {}).values()]
    if states:
        job["status"] = "queued" if set(states) == {"queued"} else "running" if set(states) - set(TERMINAL) else "completed"
    return job | {"ends": span["last"][0] + 1_000_000 * (RESULT_TTL if job["status"] == "completed" else JOB_TTL)}


def _row(request_id: str, job: dict, ended: bool = False) -> pd.DataFrame:
    states = None if job["providers"] is None else [p["status"] for p in job["providers"].values()]
    count = lambda *kinds: None if states is None else sum(s in kinds for s in states)
    running = None if states is None else sum(s not in TERMINAL for s in states)
    values = [request_id, job["status"], None if states is None else len(states), count("completed"), count("no_results"), count("failed", "expired"), running, job["error"], pd.Timestamp(job["ends"], unit="us"), ended]
    return pd.DataFrame([values], columns=[f.split()[0] for f in OUT.split(", ")]).astype({c: "Int64" for c in ("total", "completed", "no_results", "failed", "running")})


def _fold(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One request's events of a micro-batch, or the end of its entry. Spans that the watermark has passed are folded into
    the job; those that may still get events are kept as they are."""
    job, spans, upto = state.get if state.exists else ("null", "{}", -1)
    job, spans = json.loads(job), json.loads(spans)
    if state.hasTimedOut:
        state.remove()
        for at in sorted(spans, key=int):
            job = _after_span(job, spans[at])
        yield _row(key[0], {"status": "expired", "providers": None, "error": None, "ends": job["ends"]}, True)
        return
    passed = state.getCurrentWatermarkMs() * 1000 // SPAN
    for frame in frames:
        for r in frame.itertuples(index=False):
            at = [r.ts.value // 1000, int(r.seq)]
            if at[0] // SPAN > upto:
                _take(spans, at, r.provider_key, r.kind, r.error, None if r.providers is None else list(r.providers))
    now = job
    for at in sorted(spans, key=int):
        now = _after_span(now, spans[at])
        if int(at) < passed:
            job, upto = now, int(at)
            del spans[at]
    if now is None:
        return
    state.update((json.dumps(job), json.dumps(spans), upto))
    state.setTimeoutTimestamp(max(now["ends"] // 1000, state.getCurrentWatermarkMs() + 1))
    yield _row(key[0], now)


def stream_jobs(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """events: a stream of request_id, provider_key, seq, kind, ts, error and providers (the keys of the providers of a
    ``create``, else null). In update mode, per request that a micro-batch changes, the job as jobs.fold_jobs gives it
    (``ended`` false); and once the watermark passes the end of its entry, a row of status expired (``ended`` true),
    with which its state goes.

    Events may come in any order within ``delay``; one that comes later, into a span that is folded already, is
    dropped. So what is held of a request is its job and the spans of the last delay, whatever its events number. Kinds
    that are unknown and rows without request, moment or seq are no events. Events without providers go to nobody.
    """
    whole = F.col("provider_key").isNull() & F.col("kind").isin(*JOB_EVENTS, "create")
    known = events.where(F.col("request_id").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull()).where(whole | F.col("provider_key").isNotNull() & F.col("kind").isin(*PROVIDER_EVENTS))
    slim = known.select("request_id", "provider_key", F.col("seq").cast("long").alias("seq"), "kind", F.col("ts").cast("timestamp").alias("ts"), "error", "providers")
    return slim.withWatermark("ts", delay).groupBy("request_id").applyInPandasWithState(_fold, OUT, HELD, "update", GroupStateTimeout.EventTimeTimeout)
