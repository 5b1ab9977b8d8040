"""Jobs of several providers: first state, folding of events, summary, status, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.contact import request_key, requested_npi
from factmill.functions.text import left_units, let

# Fixed values.
TERMINAL = ["completed", "no_results", "failed", "expired"]
JOB_TTL, RESULT_TTL, MOST_ERROR = 3600, 1800, 255


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def initial_jobs(requests: DataFrame) -> DataFrame:
    """requests: request_id, ordinal, providerId, npi, name, ts. A queued provider job for each."""
    c = F.col
    return requests.select(
        "request_id", request_key(c("ordinal"), c("npi"), c("providerId"), c("name")).alias("provider_key"), "providerId", requested_npi(c("npi"), c("providerId")).alias("npi"), c("name").alias("providerName"),
        F.lit("queued").alias("status"), F.lit(True).alias("loading"), F.lit(None).cast("timestamp").alias("startedAt"), F.lit(None).cast("timestamp").alias("completedAt"), F.lit(None).cast("string").alias("error"), expires_at(c("ts"), F.lit(False)).alias("expiresAt"),
    )


def fold_events(initial: DataFrame, events: DataFrame) -> DataFrame:
    """events: request_id, provider_key, seq, status, startedAt, completedAt, error. The initial jobs after all their
    events: of each field the last value that an event sets. One aggregation by key; nothing is sorted."""
    fields = ("status", "startedAt", "completedAt", "error")
    last = events.groupBy("request_id", "provider_key").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields))
    met = initial.join(last, ["request_id", "provider_key"], "left")
    out = met.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))
    return out.withColumns({"error": _cut(F.col("error")), "loading": ~is_terminal(F.col("status"))})


#: What each kind of a provider's event sets; errors are cut to MOST_ERROR.
PROVIDER_EVENTS = {"searching": "startedAt", "completed": "completedAt", "no_results": "completedAt", "failed": "completedAt"}
JOB_EVENTS = ["running", "completed", "failed"]


def provider_events(log: DataFrame) -> DataFrame:
    """log: request_id, provider_key, seq, kind, ts, error. The events of providers as fold_events takes them. Only a
    failure leaves an error: the other kinds clear it, which an empty text stands for."""
    kinds = log.where(F.col("provider_key").isNotNull() & F.col("kind").isin(*PROVIDER_EVENTS))
    at = lambda field: F.when(F.col("kind").isin(*(k for k, f in PROVIDER_EVENTS.items() if f == field)), F.col("ts"))
    error = F.when(F.col("kind") == "failed", F.coalesce("error", F.lit(""))).otherwise("")
    return kinds.select("request_id", "provider_key", "seq", F.col("kind").alias("status"), at("startedAt").alias("startedAt"), at("completedAt").alias("completedAt"), error.alias("error"))


#: Two events of a job that fall into one span of RESULT_TTL seconds are closer than any time to live, so that the job
#: can't end between them. A job after events, as an expression folds it; ends is when its entry is gone.
JOB_STATE = "struct<fallback:string,listed:boolean,jobs:array<struct<provider_key:string,status:string,startedAt:timestamp,completedAt:timestamp,error:string>>,error:string,status:string,ends:timestamp>"


def spans(log: DataFrame) -> DataFrame:
    """log: request_id, provider_key, seq, kind, ts, error. One row per request and span of RESULT_TTL seconds: first_ts,
    last_ts, the last event of the whole job (reset, at reset_at), and, as patches, what the events of each provider set
    last and when. Every step is an aggregation, so that a request of very many events meets no task as a whole: what is
    left of it grows with the time that it spans."""
    known = log.where(F.col("provider_key").isNull() & F.col("kind").isin(*JOB_EVENTS, "create") | F.col("provider_key").isNotNull() & F.col("kind").isin(*PROVIDER_EVENTS))
    at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    span = F.unix_seconds(F.col("ts").cast("timestamp"))
    each = known.select("request_id", "provider_key", "kind", "error", at.alias("at"), ((span - F.pmod(span, F.lit(RESULT_TTL))) / RESULT_TTL).cast("long").alias("span"))
    of = lambda field: F.when(F.col("kind").isin(*(k for k, f in PROVIDER_EVENTS.items() if f == field)), F.col("at"))
    parts = each.groupBy("request_id", "span", "provider_key").agg(
        F.min("at.ts").alias("first_ts"), F.max("at").alias("last"), F.max_by(F.struct("kind", "error"), "at").alias("event"), F.max(of("startedAt")).alias("started"), F.max(of("completedAt")).alias("done")
    )
    whole = F.col("provider_key").isNull()
    patch = F.when(~whole, F.struct("provider_key", "last", "event", "started", "done"))
    return parts.groupBy("request_id", "span").agg(
        F.min("first_ts").alias("first_ts"), F.max("last.ts").alias("last_ts"), F.max(F.when(whole, F.col("last"))).alias("reset_at"), F.max_by("event", F.when(whole, F.col("last"))).alias("reset"), F.collect_list(patch).alias("patches")
    )


def _cut(error: Column) -> Column:
    return F.nullif(left_units(error, MOST_ERROR), F.lit(""))


def _after_span(state: Column, span: Column, initial: Column) -> Column:
    """A job's state after the events of one span."""
    none = F.lit(None).cast("string")
    nobody = F.filter(initial, lambda j: F.lit(False))
    start = lambda fallback, listed, jobs, error: F.struct(fallback.alias("fallback"), F.lit(listed).alias("listed"), jobs.alias("jobs"), error.alias("error"))
    # What an event of the whole job leaves; else nothing, if the entry had ended by the span's first event; else what was.
    made, kind = span["reset"], span["reset"]["kind"]
    whole = F.when(kind == "create", start(F.lit("queued"), True, initial, none)).otherwise(start(kind, False, nobody, F.when(kind == "failed", _cut(made["error"]))))
    gone = F.coalesce(span["first_ts"] >= state["ends"], F.lit(True))
    held = F.struct(state["fallback"].alias("fallback"), state["listed"].alias("listed"), state["jobs"].alias("jobs"), state["error"].alias("error"))
    base = F.when(made.isNotNull(), whole).when(gone, start(F.lit("expired"), False, nobody, none)).otherwise(held)
    later = lambda at: F.coalesce(at > span["reset_at"], span["reset_at"].isNull() & at.isNotNull())

    def patched(j: Column, p: Column) -> Column:
        error = F.when(p["event"]["kind"] == "failed", _cut(p["event"]["error"]))
        new = F.struct(
            j["provider_key"].alias("provider_key"), p["event"]["kind"].alias("status"), F.when(later(p["started"]), p["started"]["ts"]).otherwise(j["startedAt"]).alias("startedAt"),
            F.when(later(p["done"]), p["done"]["ts"]).otherwise(j["completedAt"]).alias("completedAt"), error.alias("error"),
        )
        return F.when(p.isNull(), j).otherwise(new)

    def patched_all(b: Column, patches: Column) -> Column:
        jobs = F.transform(b["jobs"], lambda j: let(F.get(F.filter(patches, lambda p: p["provider_key"] == j["provider_key"]), 0), lambda p: patched(j, p)))
        return F.struct(b["fallback"].alias("fallback"), (b["listed"] | (F.size(patches) > 0)).alias("listed"), jobs.alias("jobs"), b["error"].alias("error"))

    def finished(s: Column) -> Column:
        open_, queued = (F.exists(s["jobs"], lambda j: test(j["status"])) for test in (lambda x: ~is_terminal(x), lambda x: x != "queued"))
        status = F.when(F.size(s["jobs"]) == 0, s["fallback"]).when(~queued, "queued").when(open_, "running").otherwise("completed")
        # A derived status stays when a later event finds no providers.
        return let(status, lambda x: F.struct(x.alias("fallback"), s["listed"].alias("listed"), s["jobs"].alias("jobs"), s["error"].alias("error"), x.alias("status"), expires_at(span["last_ts"], x == "completed").alias("ends")).cast(JOB_STATE))

    patches = F.filter(span["patches"], lambda p: later(p["last"]))
    return let(let(base, lambda b: patched_all(b, patches)), finished)


def replay(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests: as initial_jobs takes them. log: request_id, provider_key (null for events of the whole job), seq, kind,
    ts, error. Per request of either the job after all its events in order of ts and seq: ``state``, a JOB_STATE.

    A request is created at its ts, before any event of that moment. running, completed and failed of the whole job replace
    it: its providers are gone. An event of a provider changes that provider if the job has it; else it only marks the
    list of providers as there, and empty. An event at or after the end of the entry finds an expired job. Each event
    sets the end anew: the result's time to live if the job is then completed, else the job's. Kinds that are unknown
    are no events.
    """
    none = F.lit(None)
    first = initial_jobs(requests)
    jobs = first.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("provider_key", "status", "startedAt", "completedAt", "error"))).alias("initial"))
    made = requests.groupBy("request_id").agg(F.min(F.col("ts").cast("timestamp")).alias("ts"))
    created = made.select("request_id", none.cast("string").alias("provider_key"), F.lit(-(2**63)).alias("seq"), F.lit("create").alias("kind"), "ts", none.cast("string").alias("error"))
    events = log.where(~F.col("kind").eqNullSafe("create")).select("request_id", "provider_key", F.col("seq").cast("long").alias("seq"), "kind", F.col("ts").cast("timestamp").alias("ts"), "error")
    listed = spans(created.unionByName(events)).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("span", "first_ts", "last_ts", "reset_at", "reset", "patches"))).alias("spans"))
    nobody = F.array().cast("array<struct<provider_key:string,status:string,startedAt:timestamp,completedAt:timestamp,error:string>>")
    met = listed.join(jobs, "request_id", "left").withColumn("initial", F.coalesce("initial", nobody))
    absent = F.struct(F.lit("expired").alias("fallback"), F.lit(False).alias("listed"), nobody.alias("jobs"), none.cast("string").alias("error"), F.lit("expired").alias("status"), none.cast("timestamp").alias("ends")).cast(JOB_STATE)
    return met.select("request_id", F.aggregate("spans", absent, lambda s, x: _after_span(s, x, F.col("initial"))).alias("state"))


def fold_jobs(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests and log: as replay takes them. Per request job_status, summary counts (null where the whole job was
    replaced and no provider's event came since), error and expiresAt after all events."""
    s = replay(requests, log).select("request_id", "state.*")
    of = lambda *kinds: F.when(F.col("listed"), F.size(F.filter("jobs", lambda j: j["status"].isin(*kinds))).cast("long"))
    running = F.when(F.col("listed"), F.size(F.filter("jobs", lambda j: ~is_terminal(j["status"]))).cast("long"))
    return s.select(
        "request_id", F.col("status").alias("job_status"), F.when(F.col("listed"), F.size("jobs").cast("long")).alias("total"), of("completed").alias("completed"), of("no_results").alias("no_results"), of("failed", "expired").alias("failed"), running.alias("running"), "error",
        F.col("ends").alias("expiresAt"),
    )


def safe_job_error(status: Column, message: Column) -> Column:
    """What a caller may see of an error: the message of a caller's own mistake, else a plain sentence."""
    return F.when(status < 500, message).otherwise("Provider profile search failed.")


def summarize(jobs: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Counts of provider jobs and the derived status per job. A job all of whose providers failed is completed."""
    s = F.col(status)
    open_ = ~is_terminal(s)
    state = F.when(F.bool_and(s == "queued"), "queued").when(F.bool_or(open_), "running").otherwise("completed")
    return jobs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "no_results").alias("no_results"), F.count_if(s.isin("failed", "expired")).alias("failed"),
        F.count_if(open_).alias("running"), state.alias("job_status"),
    )


def expires_at(ts: Column, completed: Column, job_ttl: int = JOB_TTL, result_ttl: int = RESULT_TTL) -> Column:
    """When a job's entry ends; a completed one's after the result's time to live. Both are capped."""
    seconds = F.when(completed, min(result_ttl, RESULT_TTL)).otherwise(min(job_ttl, JOB_TTL))
    return ts + F.make_interval(secs=seconds)


def read_jobs(asked: DataFrame, state: DataFrame, now: Column, key: str = "request_id") -> DataFrame:
    """The state of each job asked for; ``expired`` where there is none or its time is over."""
    live = state.where(F.col("expiresAt") > now).select(key, F.col("status").alias("_s"))
    return asked.join(live, key, "left").withColumn("status", F.coalesce("_s", F.lit("expired"))).drop("_s")
