"""Operators on whole tables: jobs, evaluation, usage, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.operators import evaluation, jobs, profiles, rollups, scoring, usage, validation
from factmill.plans import oracle
from factmill.plans.registry import query, table
from factmill.sources import counter_table, files
from factmill.streaming import counters
from factmill.streaming import jobs as streaming_jobs

# Jobs: an order is a job of one provider or two, its events follow from its key.


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and the log of events: every job has two providers. The first is searched and completes; the second is
    searched and, by the order's key, completes, finds nothing, fails, or goes on. Every 10th job fails as a whole, every
    15th is completed as a whole, after all other events."""
    k, ts = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    orders = table(spark, sf_dir, "orders").select(k.alias("k"), ts.alias("ts"))
    none = F.lit(None).cast("string")
    ask = lambda i: F.struct(F.lit(i).alias("ordinal"), none.alias("providerId"), none.alias("npi"), F.lit(f"name {i}").alias("name"))
    requests = orders.select(F.col("k").alias("request_id"), "ts", F.explode(F.array(ask(0), ask(1))).alias("r")).select("request_id", "ts", "r.*")
    at = lambda s: F.col("ts") + F.make_interval(secs=F.lit(s))
    event = lambda seq, key, kind, error=none: F.struct(F.lit(seq).alias("seq"), (none if key is None else F.lit(key)).alias("provider_key"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), at(seq).alias("ts"), error.alias("error"))
    m = F.col("k") % 4
    second = F.when(m == 0, "completed").when(m == 1, "no_results").when(m == 2, "failed")
    whole = F.when(F.col("k") % 10 == 0, "failed").when(F.col("k") % 15 == 0, "completed")
    made = F.array(
        event(1, "0:name:name 0", "searching"), event(2, "0:name:name 0", "completed"), event(3, "1:name:name 1", "searching"), event(4, "1:name:name 1", second, F.when(m == 2, F.repeat(F.lit("e"), 300))), event(5, None, whole, F.when(F.col("k") % 10 == 0, F.lit("broken")))
    )
    log = orders.select(F.col("k").alias("request_id"), "ts", F.explode(F.filter(made, lambda e: e["kind"].isNotNull())).alias("e")).select("request_id", "e.*")
    return requests, log


@query("""SELECT o_orderkey AS request_id, CASE WHEN w IS NOT NULL THEN w WHEN m = 3 THEN 'running' ELSE 'completed' END AS job_status, CASE WHEN w IS NULL THEN 2::BIGINT END AS total, CASE WHEN w IS NULL THEN 1 + (m = 0)::BIGINT END AS completed, CASE WHEN w IS NULL THEN (m = 1)::BIGINT END AS no_results,
  CASE WHEN w IS NULL THEN (m = 2)::BIGINT END AS failed, CASE WHEN w IS NULL THEN (m = 3)::BIGINT END AS running, CASE WHEN w = 'failed' THEN 'broken' END AS error,
  epoch(o_orderdate)::BIGINT + CASE WHEN w IS NOT NULL THEN 5 WHEN m = 3 THEN 3 ELSE 4 END + CASE WHEN w = 'failed' OR w IS NULL AND m = 3 THEN 3600 ELSE 1800 END AS ends
FROM (SELECT *, o_orderkey % 4 AS m, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 15 = 0 THEN 'completed' END AS w FROM orders)""")
def job_fold(spark, sf_dir):
    """Jobs after all their events: derived status and counts, or what replaced the whole job, and when they end."""
    out = jobs.fold_jobs(*_jobs(spark, sf_dir))
    return out.select("request_id", "job_status", "total", "completed", "no_results", "failed", "running", "error", F.unix_seconds("expiresAt").alias("ends"))


@query("""SELECT o_orderkey AS request_id, '1:name:name 1' AS provider_key, CASE m WHEN 0 THEN 'completed' WHEN 1 THEN 'no_results' WHEN 2 THEN 'failed' ELSE 'searching' END AS status, m = 3 AS loading, CASE WHEN m = 2 THEN 255 END AS error_length, 3::BIGINT AS started, CASE WHEN m < 3 THEN 4::BIGINT END AS done
FROM (SELECT *, o_orderkey % 4 AS m FROM orders) UNION ALL SELECT o_orderkey, '0:name:name 0', 'completed', false, NULL, 1::BIGINT, 2::BIGINT FROM orders""")
def provider_fold(spark, sf_dir):
    """Each provider's part of a job after its events."""
    requests, log = _jobs(spark, sf_dir)
    folded = jobs.fold_events(jobs.initial_jobs(requests), jobs.provider_events(log)).join(requests.select("request_id", "ts").distinct(), "request_id")
    since = lambda c: (F.unix_seconds(c) - F.unix_seconds("ts")).alias
    return folded.select("request_id", "provider_key", "status", "loading", F.length("error").alias("error_length"), since("startedAt")("started"), since("completedAt")("done"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 AND epoch(o_orderdate) + 1860 > epoch(now) THEN 'completed' WHEN o_orderkey % 2 = 1 AND epoch(o_orderdate) + 3600 > epoch(now) THEN 'running' ELSE 'expired' END AS status
FROM orders, (SELECT TIMESTAMP '1995-06-17 00:45:00' AS now)""")
def job_states(spark, sf_dir):
    """States of jobs written in two batches, of which the later, if it ends sooner, is what is read: all jobs run, and
    every other is completed a minute later. At a moment when its end is over and that of the first is not, it is gone."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    path, now = files.scratch(spark, "jobs"), "1995-06-17 00:45:00"
    done = F.lit(True)
    files.write_jobs(orders.select("request_id", F.lit("running").alias("status"), jobs.expires_at(F.col("ts"), ~done).alias("expiresAt")), path, 9)
    later = jobs.expires_at(F.col("ts") + F.make_interval(secs=F.lit(60)), done)
    files.write_jobs(orders.where("request_id % 2 = 0").select("request_id", F.lit("completed").alias("status"), later.alias("expiresAt")), path, 10)
    return jobs.read_jobs(orders.select("request_id"), files.live_jobs(spark, path, now), F.lit(now).cast("timestamp"))


# Users as jobs: each is created with two providers at their first event, and every event is one of a job, in a time that
# runs twenty times as fast, so that entries end between some and not between others.

_REPLAY_SQL = """WITH RECURSIVE e AS (
  SELECT user_id AS u, floor(epoch(ts) / 20)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 20), event_id) AS n,
    CASE WHEN event_id % 9 = 0 AND event_type = 'error' OR event_id % 9 < 2 AND event_type IN ('signup', 'click') THEN NULL ELSE event_id % 3 END AS p, event_type AS y
  FROM events),
k AS (SELECT u, t, n, p, CASE WHEN p IS NULL THEN CASE y WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END ELSE CASE y WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'no_results' WHEN 'error' THEN 'failed' ELSE 'searching' END END AS kind FROM e),
s AS (
  SELECT u, 0::BIGINT AS n, 'queued' AS status, true AS listed, 'queued' AS a, 'queued' AS b, NULL::VARCHAR AS error, min(t) + 3600 AS ends FROM k GROUP BY u
  UNION ALL
  SELECT u, n, status, p IS NOT NULL, a, b, error, t + CASE WHEN status = 'completed' THEN 1800 ELSE 3600 END FROM (
    SELECT u, n, t, p, a, b, error, CASE WHEN a IS NULL THEN fallback WHEN a = 'queued' AND b = 'queued' THEN 'queued' WHEN a IN ('queued', 'searching') OR b IN ('queued', 'searching') THEN 'running' ELSE 'completed' END AS status FROM (
      SELECT k.u, k.n, k.t, k.p, CASE WHEN p IS NULL THEN kind WHEN k.t >= ends THEN 'expired' ELSE status END AS fallback,
        CASE WHEN p IS NOT NULL AND k.t < ends AND a IS NOT NULL THEN CASE WHEN p = 0 THEN kind ELSE a END END AS a,
        CASE WHEN p IS NOT NULL AND k.t < ends AND a IS NOT NULL THEN CASE WHEN p = 1 THEN kind ELSE b END END AS b,
        CASE WHEN p IS NULL THEN CASE WHEN kind = 'failed' THEN 'error' END WHEN k.t < ends THEN error END AS error
      FROM s JOIN k ON k.u = s.u AND k.n = s.n + 1) x) y)
SELECT u AS request_id, status AS job_status, CASE WHEN a IS NOT NULL THEN 2 WHEN listed THEN 0 END::BIGINT AS total,
  CASE WHEN a IS NOT NULL THEN (a = 'completed')::BIGINT + (b = 'completed')::BIGINT WHEN listed THEN 0 END AS completed, CASE WHEN a IS NOT NULL THEN (a = 'no_results')::BIGINT + (b = 'no_results')::BIGINT WHEN listed THEN 0 END AS no_results,
  CASE WHEN a IS NOT NULL THEN (a = 'failed')::BIGINT + (b = 'failed')::BIGINT WHEN listed THEN 0 END AS failed, CASE WHEN a IS NOT NULL THEN (a IN ('queued', 'searching'))::BIGINT + (b IN ('queued', 'searching'))::BIGINT WHEN listed THEN 0 END AS running,
  error, ends::BIGINT AS ends
FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1"""


def _user_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and log, as jobs.replay takes them."""
    c = F.col
    seconds = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 20_000_000).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", c("user_id").cast("string").alias("request_id"), F.timestamp_seconds(seconds).alias("ts"))
    none = F.lit(None).cast("string")
    first = rows.groupBy("request_id").agg(F.min("ts").alias("ts"))
    requests = first.select("request_id", "ts", F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("ordinal", "name")).select("request_id", "ordinal", none.alias("providerId"), none.alias("npi"), "name", "ts")
    y, m = c("event_type"), c("event_id") % 9
    whole = (m == 0) & (y == "error") | (m < 2) & y.isin("signup", "click")
    key = F.when(~whole, F.get(F.array(F.lit("0:name:a"), F.lit("1:name:b"), F.lit("2:name:nobody")), c("event_id") % 3))
    kind = F.when(whole, F.when(y == "error", "failed").when(y == "signup", "running").otherwise("completed")).when(y == "click", "completed").when(y == "purchase", "no_results").when(y == "error", "failed").otherwise("searching")
    return requests, rows.select("request_id", key.alias("provider_key"), c("event_id").alias("seq"), kind.alias("kind"), "ts", F.when(kind == "failed", y).alias("error"))


@query(_REPLAY_SQL.replace("SELECT u AS request_id", "SELECT u::VARCHAR AS request_id"))
def job_replay(spark, sf_dir):
    """Jobs after events in every order: events after a job was replaced, and events before and after its end."""
    out = jobs.fold_jobs(*_user_jobs(spark, sf_dir))
    return out.select("request_id", "job_status", "total", "completed", "no_results", "failed", "running", "error", F.unix_seconds("expiresAt").alias("ends"))


@query(_REPLAY_SQL.replace("SELECT u AS request_id", "SELECT u::VARCHAR AS request_id"))
def stream_jobs(spark, sf_dir):
    """The same from a stream with keyed state: three runs over what came since the last, each going on from its checkpoint.
    Of each job the last row that isn't the end of its entry."""
    requests, log = _user_jobs(spark, sf_dir)
    none = F.lit(None)
    created = requests.groupBy("request_id", "ts").agg(F.array_sort(F.collect_list(F.concat("ordinal", F.lit(":name:"), "name"))).alias("providers"))
    created = created.select("request_id", none.cast("string").alias("provider_key"), F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("kind"), "ts", none.cast("string").alias("error"), "providers")
    events = files.written(log.withColumn("providers", none.cast("array<string>")).unionByName(created), "events")
    source, out, checkpoint = (files.scratch(spark, n) for n in ("stream", "changes", "progress"))
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    third = F.floor((F.unix_seconds("ts") - (first or 0)) * 3 / ((last or 0) - (first or 0) + 1))
    for run in range(3):
        events.where(third == run).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        changed = streaming_jobs.stream_jobs(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        changed.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start().awaitTermination()
    rows = spark.read.schema(f"{streaming_jobs.OUT}, batch long").parquet(out).where("not ended")
    fields = ["job_status", "total", "completed", "no_results", "failed", "running", "error"]
    return rows.groupBy("request_id").agg(F.max_by(F.struct(*fields, F.unix_seconds("expiresAt").alias("ends")), "batch").alias("r")).select("request_id", "r.*")


# Evaluation: a customer is a case; what was observed follows from its key.


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    npi = F.lpad(k.cast("string"), 10, "0")
    cases = customers.select(k, npi.alias("gold_npi"), F.col("c_name").alias("asked_name"), F.when(k % 3 > 0, F.concat(k.cast("string"), F.lit(" Main Street"))).alias("baseline_address"), F.lit(1).alias("version"))
    older = cases.withColumns({"gold_npi": F.lit("old"), "version": F.lit(0)})
    present = k % 7 > 0
    when = lambda c: F.when(present, c)
    observed = customers.select(
        k, F.when(k % 11 == 0, "failed").otherwise("completed").alias("status"), F.timestamp_seconds(k).alias("startedAt"), F.timestamp_millis(k * 1000 + k % 1000).alias("completedAt"), present.alias("present"), when(F.when(k % 5 == 0, "0").otherwise(npi)).alias("npi"),
        when(F.when(k % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("  "))).when(k % 13 == 0, "Nobody").otherwise(F.col("c_name"))).alias("provider_name"), when(F.when(k % 4 > 0, F.concat(k.cast("string"), F.lit(" main st.")))).alias("address"),
    )
    return observed, older.union(cases)


_JUDGED = """(SELECT *, CASE WHEN NOT present THEN 'missing' WHEN k % 5 = 0 THEN 'npi' WHEN k % 2 = 1 AND k % 13 = 0 THEN 'name' ELSE 'match' END AS reason, CASE WHEN k % 3 > 0 THEN present AND k % 4 > 0 END AS agrees
  FROM (SELECT c_custkey AS k, c_custkey % 7 > 0 AS present, c_custkey % 1000 AS latency FROM customer))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, cases = _observed(spark, sf_dir)
    met = evaluation.join_cases(observed, cases, "c_custkey", "version")
    return profiles.settled(evaluation.score_cases(evaluation.with_latency(met, "startedAt", "completedAt"), "c_custkey"))


@query(f"""SELECT k AS c_custkey, reason, reason = 'match' AS identity_correct, present AND reason <> 'match' AS wrong_provider, agrees AS address_agrees, NOT agrees AS address_conflicts, latency AS latency_ms, NOT present OR k % 11 = 0 AS failed FROM {_JUDGED}""")
def case_scores(spark, sf_dir):
    """Observations joined with the last version of their case, each judged: the right provider, the address on file."""
    return _judged(spark, sf_dir)


_OVERVIEW = {"identity_accuracy": ("ok", "n"), "wrong_provider_rate": ("wrong", "n"), "failure_rate": ("fell", "n"), "address_agreement": ("agree", "paired"), "address_conflict": ("paired - agree", "paired")}


@query(f"""WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE reason = 'match') AS ok, count(*) FILTER (WHERE present AND reason <> 'match') AS wrong, count(*) FILTER (WHERE NOT present OR k % 11 = 0) AS fell, count(agrees) AS paired, count(*) FILTER (WHERE agrees) AS agree, avg(latency) AS mean, max(latency) AS most FROM {_JUDGED})
SELECT n AS cases, {', '.join(oracle.ratio(name, f'({a})', b) for name, (a, b) in _OVERVIEW.items())}, mean AS mean_latency_ms, most AS max_latency_ms FROM t""")
def case_overview(spark, sf_dir):
    return evaluation.case_overview(_judged(spark, sf_dir))


_PADS = {name: "".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0")) for name, pad in (("inner", 0x36), ("outer", 0x5C))}


@query(f"""SELECT c_custkey, 1::BIGINT AS emitted, (c_custkey % 3 = 0)::BIGINT AS unsafe_disclosures, sha256('{_PADS["outer"]}'::BLOB || unhex(sha256('{_PADS["inner"]}'::BLOB || encode('phones:216' || lpad(c_custkey::VARCHAR, 7, '0'))))) AS hash FROM customer""")
def unsafe_disclosures(spark, sf_dir):
    """Personal numbers known by their hash alone, and who shows them."""
    from factmill.functions.contact import hmac_sha256

    k = F.col("c_custkey")
    number = F.concat(F.lit("216"), F.lpad(k.cast("string"), 7, "0"))
    customers = table(spark, sf_dir, "customer").select(k, F.lit("phones").alias("field"), number.alias("value"), hmac_sha256(F.concat(F.lit("phones:"), number), "key").alias("hash"))
    gold = customers.where(k % 3 == 0).select(k, "field", F.lit(None).cast("string").alias("value"), F.lit("unsafe_personal").alias("status"), F.lit(False).alias("display_safe"), F.col("hash").alias("value_hash"))
    shown = customers.select(k, "field", F.lit(0).alias("ordinal"), "value", F.lit(False).alias("cited"))
    scores = evaluation.score_fields(customers, gold, shown, "c_custkey", "key")
    return scores.join(customers.select(k, "hash"), "c_custkey").select("c_custkey", "emitted", "unsafe_disclosures", "hash")


_RATIO = {"identity_accuracy": "match", "wrong_provider_rate": "present AND NOT match", "failure_rate": "NOT present OR k % 11 = 0"}


@query(f"""WITH o AS (SELECT s_suppkey AS k, s_suppkey % 7 > 0 AS present, s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AS match, s_name, s_nationkey FROM supplier),
t AS (SELECT count(*) AS cases, {', '.join(f"count(*) FILTER (WHERE {c})::DOUBLE / count(*) AS {n}" for n, c in _RATIO.items())}, 
  count(*) FILTER (WHERE k % 4 > 0 AND present AND k % 3 > 0)::DOUBLE / nullif(count(*) FILTER (WHERE k % 4 > 0), 0) AS address_agreement, max(s_nationkey)::BIGINT AS max_latency_ms,
  count(*) FILTER (WHERE present AND k % 2 = 0)::DOUBLE / nullif(count(*) FILTER (WHERE present), 0) AS phone_precision, count(*) FILTER (WHERE present AND k % 2 = 0)::DOUBLE / nullif(count(*), 0) AS phone_recall FROM o)
SELECT cases, identity_accuracy, wrong_provider_rate, failure_rate, address_agreement, max_latency_ms, phone_precision, phone_recall, 1.0::DOUBLE AS mean_jaccard FROM t""")
def score_reports(spark, sf_dir):
    """An evaluation of suppliers from its files to its reports: cases as JSON lines, an observation in a document for each
    supplier, found through a manifest, and the reports read back."""
    root = files.scratch(spark, "evaluation")
    c, k = F.col, F.col("s_suppkey")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    npi, moment = F.lpad(k.cast("string"), 10, "0"), F.lit("2026-01-01T00:00:00.000Z")
    source = F.array(F.struct(F.lit("approved_directory").alias("kind"), F.lit("hospital.org").alias("domain"), moment.alias("capturedAt"), F.lit("e").alias("evidenceId")))
    phone = lambda n: text("216444", F.lpad(n.cast("string"), 4, "0"))
    fact = F.struct(phone(k % 10000).alias("value"), F.lit(None).cast("string").alias("valueHash"), F.lit("confirmed_current").alias("status"), F.lit(True).alias("displaySafe"), source.alias("sources"))
    none = F.filter(F.array(fact), lambda x: F.lit(False))
    # Dealt to all cores, as each document is a file of its own, which takes far longer than its row.
    supplier = files.spread(table(spark, sf_dir, "supplier"))
    request = F.struct(npi.alias("npi"), c("s_name").alias("name"), F.lit("Cardiology").alias("specialty"), F.lit("Ames").alias("city"), F.lit("IA").alias("state"), F.lit("50010").alias("zip"))
    strata = F.struct(F.lit("individual").alias("entityType"), F.lit("midwest").alias("region"), F.lit("urban").alias("rurality"), F.lit("g").alias("specialtyGroup"), F.array().cast("array<string>").alias("edgeCases"))
    base = F.struct(moment.alias("capturedAt"), npi.alias("providerId"), c("s_name").alias("name"), F.when(k % 4 > 0, text(k, " Main Street")).alias("address"))
    gold = F.struct(F.struct(npi.alias("npi"), F.lit("individual").alias("entityType")).alias("identity"), F.array(fact).alias("phones"), none.alias("addresses"), none.alias("websites"), none.alias("ratings"))
    supplier.select(F.lit(1).alias("schemaVersion"), k.cast("string").alias("caseId"), request.alias("request"), strata.alias("strata"), base.alias("cmsBaseline"), gold.alias("gold")).write.json(f"{root}/cases")
    shown = F.struct(phone(F.when(k % 2 == 0, k % 10000).otherwise(9999 - k % 10000)).alias("value"), F.lit("s").alias("sourceId"))
    place = F.struct(F.when(k % 3 > 0, text(k, " main st.")).otherwise("elsewhere").alias("addressLine1"), F.lit("s").alias("sourceId"))
    profile = F.struct(F.when(k % 5 > 0, npi).otherwise("0000000000").alias("npi"), F.upper("s_name").alias("providerName"), F.array(shown).alias("phoneNumbers"), F.array(place).alias("locations"))
    seen = supplier.select(k.cast("string").alias("caseId"), F.lit(1).alias("repeat"), F.lit(1).alias("schemaVersion"), c("s_nationkey").cast("long").alias("latencyMs"), F.when(k % 11 == 0, "failed").otherwise("completed").alias("terminalStatus"), F.when(k % 7 > 0, profile).alias("profile"))
    # The key stands in the document too: what partitions files leaves them.
    seen.withColumn("part", c("caseId")).write.partitionBy("part").json(f"{root}/observations")
    supplier.select(text(f"{root}/observations/part=", k).alias("path")).write.text(f"{root}/manifest")
    scoring.score_files(spark, f"{root}/cases", f"{root}/manifest", f"{root}/reports")
    report = spark.read.option("multiLine", True).json(f"{root}/reports/aggregate")
    phones = F.get(F.filter("fields", lambda f: f["field"] == "phones"), 0)
    means = spark.read.option("multiLine", True).json(f"{root}/reports/repeat-variance/means").select("mean_jaccard", F.lit(1).alias("one"))
    of = ["cases", "identity_accuracy", "wrong_provider_rate", "failure_rate", "address_agreement", "max_latency_ms"]
    return report.select(*of, phones["emitted_precision"].alias("phone_precision"), phones["gold_recall"].alias("phone_recall"), F.lit(1).alias("one")).join(means, "one").drop("one")


# Usage.


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS identity_retries, sum(turn % 3)::BIGINT AS web_search_calls, bool_and(turn < 4) AS estimated, CASE WHEN bool_and(turn < 4) THEN 'v1' END AS pricing_version, max(turn * 10 + 1) AS longest FROM conversations GROUP BY conv_id""")
def search_records(spark, sf_dir):
    """Turns as attempts of a search: whether its cost is known, retries, calls and durations."""
    t = F.col("turn")
    zero = F.lit(0).cast("long")
    attempts = table(spark, sf_dir, "conversations").select(
        "conv_id", t.alias("attempt_ordinal"), F.when(F.col("role") == "assistant", "identity_retry").otherwise("initial").alias("attempt"), (t < 4).alias("usagePresent"), zero.alias("uncachedInputTokens"), zero.alias("cachedInputTokens"), zero.alias("cacheWriteTokens"), zero.alias("outputTokens"),
        (t % 3).alias("webSearchCalls"), (t * 10 + 0.5).alias("duration"),
    )
    records = usage.usage_records(attempts, {"version": "v1", "input": 1.0, "cached": 1.0, "cache_write": 1.0, "output": 1.0, "search": 1.0})
    longest = records.groupBy("conv_id").agg(F.max("duration_ms").alias("longest"))
    return usage.search_costs(records, "conv_id", "v1").join(longest, "conv_id")


@query("""WITH a AS (SELECT user_id AS u, event_id, event_type, value, ts, sum(CASE WHEN gap < 14400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events))
SELECT u AS user_id, arg_min(event_type, event_id) AS model, count(*) AS attempts, count(*) - 1 AS retries, count(*) FILTER (WHERE event_type = 'error') AS missing_usage,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN sum(event_id)::BIGINT END AS input_tokens, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended FROM a GROUP BY u, s""")
def stream_searches(spark, sf_dir):
    """Events as attempts of a user's searches, which end after four hours without another; from a stream in three runs, the
    last of which also brings an event of nobody long after, so that all are over."""
    c = F.col
    e = table(spark, sf_dir, "events")
    bad = c("event_type") == "error"
    rows = e.select("user_id", c("ts").cast("timestamp").alias("ts"), c("event_id").alias("attempt_ordinal"), c("event_type").alias("model"), (~bad).alias("usagePresent"), F.when(~bad, c("event_id")).alias("inputTokens"), F.lit(0.0).alias("total_usd"))
    rows = files.written(rows, "attempts")
    source, out, checkpoint = (files.scratch(spark, n) for n in ("stream", "searches", "progress"))
    first, last = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    third = F.floor((F.unix_seconds("ts") - (first or 0)) * 3 / ((last or 0) - (first or 0) + 1))
    after = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(F.lit((last or 0) + 864_000)).alias("ts"), *(F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in rows.columns[2:]))
    for run in range(3):
        part = rows.where(third == run)
        (part.unionByName(after) if run == 2 else part).write.mode("append").parquet(source)
        closed = counters.stream_summaries(spark.readStream.schema(rows.schema).parquet(source), "user_id", "4 hours", "1 hour")
        closed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(closed.schema).parquet(out).where("user_id is not null")
    return done.select("user_id", "model", "attempts", "retries", "missing_usage", c("inputTokens").alias("input_tokens"), F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"))


@query("SELECT role AS model, count(*) AS records, sum(turn * 10 + 1)::BIGINT AS took FROM conversations GROUP BY role")
def usage_log(spark, sf_dir):
    """Records of usage added to a log in two writes, and read back."""
    path = files.scratch(spark, "usage")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("model"), usage.duration_ms(F.col("turn") * 10 + 0.5).alias("duration_ms"))
    for odd in (0, 1):
        files.write_records(turns.where(F.col("conv_id") % 2 == odd), path)
    log = files.read_json_lines(spark, path, "conv_id long, model string, duration_ms long")
    return log.groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.sum("duration_ms").alias("took"))


# Files and streams.


@query("SELECT user_id, event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def json_lines_round_trip(spark, sf_dir):
    """Events as JSON lines and back, by a schema that every line must fit."""
    path = files.scratch(spark, "lines")
    table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value").write.json(path)
    rows = files.read_json_lines(spark, path, "user_id long, event_type string, day date, value double")
    return rows.groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT c_custkey % 50 AS case_id, c_custkey % 3 AS repeat, count(*) AS n, min(c_name) AS first FROM customer GROUP BY ALL")
def observation_files(spark, sf_dir):
    """Observations in a folder for each case and repeat, read back."""
    path = files.scratch(spark, "observations")
    files.write_observations(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("caseId"), (F.col("c_custkey") % 3).alias("repeat"), "c_name"), path)
    rows = spark.read.schema("c_name string, caseId long, repeat long").json(path)
    return rows.groupBy(F.col("caseId").alias("case_id"), "repeat").agg(F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first"))


@query("SELECT count(*) AS customers, min(c_name) AS first FROM customer")
def report_file(spark, sf_dir):
    """A report of one row as indented JSON, found through a manifest of paths, and read back."""
    path, listed = files.scratch(spark, "report"), files.scratch(spark, "manifest")
    files.write_report(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers"), F.min("c_name").alias("first")), path)
    spark.createDataFrame([(path,), ("",)], "value string").write.text(listed)
    return files.read_manifest(spark, listed, "customers long, first string")


@query("SELECT count(*) AS cases, min(c_custkey)::VARCHAR AS first FROM customer")
def case_file(spark, sf_dir):
    """Cases as JSON lines, read strictly: one that breaks the schema would fail the query."""
    from factmill.plans.case_queries import _CASE

    path = files.scratch(spark, "cases")
    line = F.replace(F.lit(_CASE.replace("\n", " ")), F.lit('"caseId": "c"'), F.concat(F.lit('"caseId": "'), F.col("c_custkey").cast("string"), F.lit('"')))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return files.read_cases(spark, path).agg(F.count(F.lit(1)).alias("cases"), F.min(F.col("caseId").cast("long")).cast("string").alias("first"))


_CLICKS_SQL = "SELECT 'org' AS broker_org_id, '' AS provider_npi, 'u' || user_id AS provider_id, '216-444-2200' AS normalized_phone, ts::DATE AS click_day, count(*) AS click_count FROM events WHERE event_type = 'click' GROUP BY ALL"


def _clicks(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").select(F.lit("org").alias("broker_org_id"), F.lit("").alias("provider_npi"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider_id"), F.lit("216-444-2200").alias("normalized_phone"), F.to_date("ts").alias("click_day"))


@query(_CLICKS_SQL)
def counter_upserts(spark, sf_dir):
    """Clicks added to a table of counters in two batches, one of them twice, then made one."""
    path = files.scratch(spark, "counts")
    rows = _clicks(table(spark, sf_dir, "events")).withColumn("odd", F.crc32("provider_id") % 2)
    for batch in (0, 1, 1):
        counter_table.add_counts(path, rollups.click_rollup(rows.where(F.col("odd") == batch)), rollups.CLICK_KEYS, ["click_count"], "click_day", batch)
    counter_table.compact_counts(spark, path, rollups.CLICK_KEYS, ["click_count"], "click_day")
    return counter_table.read_counts(spark, path, rollups.CLICK_KEYS, ["click_count"])


@query(_CLICKS_SQL)
def stream_counters(spark, sf_dir):
    """The same from a stream: each micro-batch adds what it counts."""
    events = table(spark, sf_dir, "events")
    source, path, checkpoint = (files.scratch(spark, n) for n in ("stream", "counts", "progress"))
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    counters.stream_counts(_clicks(stream), rollups.click_rollup, rollups.CLICK_KEYS, ["click_count"], "click_day", path, checkpoint).awaitTermination()
    return counter_table.read_counts(spark, path, rollups.CLICK_KEYS, ["click_count"])


@query("SELECT user_id AS request_id, event_type AS provider_key, arg_max(value, event_id)::VARCHAR AS status, CASE WHEN arg_max(event_id, event_id) % 2 = 0 THEN 'e' END AS error FROM events GROUP BY ALL")
def latest_states(spark, sf_dir):
    """The last state of each key by sequence."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("provider_key"), F.col("event_id").alias("seq"), F.col("value").cast("string").alias("status"), F.when(F.col("event_id") % 2 == 0, "e").alias("error"))
    return counters.latest_states(e)


@query("SELECT user_id, sum(n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT user_id, 2 * count(*) FROM events WHERE event_type = 'click' GROUP BY user_id) GROUP BY user_id")
def counter_merge(spark, sf_dir):
    """Held counters and new ones as one."""
    e = table(spark, sf_dir, "events")
    held = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    new = e.where("event_type = 'click'").groupBy("user_id").agg((2 * F.count(F.lit(1))).alias("n"))
    return rollups.merge_counts(held, new, ["user_id"], ["n"])


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def enforced_rows(spark, sf_dir):
    """Rows that a rule refuses are dropped; under the strict rule they would fail the query."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    fine = validation.enforce(e, F.when(F.col("event_type") == "error", "BAD_TYPE"), strict=False)
    return validation.enforce(fine, F.when(F.col("event_type") == "error", "BAD_TYPE"), strict=True)
