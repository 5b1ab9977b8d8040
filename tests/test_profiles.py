import json

import pytest
from pyspark.sql import functions as F

from factmill.functions import contact, text, urls
from factmill.functions.stats import wilson
from factmill.operators import evaluation, jobs, profiles, rollups, usage, validation
from factmill.sources import counter_table, files
from factmill.streaming import counters

CLINIC = "https://eastside-clinic.com/ada"
PROFILE = {
    "name": "Ada Lane",
    "npi": "1234567890",
    "phones": [{"number": "(216) 444-2200", "sourceId": "s1"}, {"value": "216 444 2200", "sourceId": "s2"}, {"value": "216-444-9999", "sourceId": "s3"}, {"value": "555-0100", "sourceId": "s1"}],
    "addresses": {"street1": "1 Main Street", "city": "Ames", "state": "IA", "zip": "50010", "source": {"id": "s1"}},
    "websites": [{"url": CLINIC, "sourceId": "s1"}],
    "sources": [
        {"id": "s1", "title": "Ada Lane clinic", "domain": "eastside-clinic.com", "url": CLINIC},
        {"id": "s2", "title": "Ada Lane", "domain": "healthgrades.com", "url": "https://www.healthgrades.com/ada"},
        {"id": "s3", "title": "Ada Lane", "domain": "spokeo.com", "url": "https://spokeo.com/ada"},
    ],
}


def response(profile, *cited):
    notes = [{"type": "url_citation", "url": u} for u in cited]
    body = "```json\n" + json.dumps({"profiles": [profile]}) + "\n```"
    return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": body, "annotations": notes}]}], "usage": {"input_tokens": 10, "input_tokens_details": {"cached_tokens": 4}, "output_tokens": 3}})


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_responses_become_profiles(spark):
    urls_ = (CLINIC, "https://www.healthgrades.com/ada", "https://spokeo.com/ada")
    raw = spark.createDataFrame([(1, response(PROFILE, *urls_)), (2, response(PROFILE)), (3, "no json"), (4, None)], "id long, body string")
    got = profiles.parse_responses(raw, "body", ["id"]).collect()
    assert [r["id"] for r in got] == [1]
    r = got[0]
    # The official source ranks first and equal numbers are one; the blocked source and the made-up number are gone.
    assert [p["value"] for p in r["phoneNumbers"]] == ["(216) 444-2200"]
    assert r["locations"][0]["addressLine1"] == "1 Main Street"
    assert [w["value"] for w in r["websites"]] == [CLINIC]
    assert [s["id"] for s in r["sources"]] == ["s1"] or {s["id"] for s in r["sources"]} == {"s1", "s2"}


def test_first_match_by_ordinal_with_veto(spark):
    people = spark.createDataFrame([("a", "1111111111", None, "Ada"), ("b", "2222222222", "x", "Bo"), ("c", None, None, "Cy")], "k string, npi string, providerId string, providerName string")
    asked = spark.createDataFrame([(0, "9999999999", None, "Ada"), (1, None, None, "ada "), (2, "1111111111", None, "Z"), (3, "2222222222", "x", "Q")], "ordinal int, npi string, providerId string, name string")
    got = {r["k"]: r["ordinal"] for r in profiles.match_requests(people, asked, "k").collect()}
    assert got == {"a": 1, "b": 3}


def test_text_and_url_functions(spark):
    lit = F.lit
    assert value(spark, text.contains_unsafe(lit("émember")))  # ASCII word boundary
    assert value(spark, text.clean_public_text(lit("a \x00 b "), 10)) == "a b"
    assert value(spark, text.safe_fact(lit("see www.x.org"))) is None
    assert value(spark, text.safe_phone(lit("216-444-2200")))["value"] == "216-444-2200"
    assert value(spark, text.safe_phone(lit("123")))["reason"] == "INVALID_PHONE_VALUE"
    assert value(spark, urls.safe_public_url(lit("HTTPS://Clinic.com:443/a?utm_x=1&b=2&a=1#f"))) == "https://clinic.com/a?a=1&b=2"
    assert value(spark, urls.safe_public_url(lit("https://u:p@clinic.com/"))) is None
    assert value(spark, urls.safe_domain(lit("www.Clinic.com"), lit(None).cast("string"))) == "clinic.com"
    assert value(spark, urls.safe_domain(lit("localhost"), lit(None).cast("string"))) == "public-source"
    assert value(spark, contact.phone_key(lit("1 216 444 2200 ext 5"))) == "2164442200x5"
    assert value(spark, contact.address_parts(lit("1 Main Street, Ames 50010")))["canonical"] == "1 main st ames 50010"
    w = value(spark, wilson(F.lit(8), F.lit(10)))
    assert round(w["lower"], 4) == 0.4902 and round(w["upper"], 4) == 0.9433


def test_hmac(spark):
    import hashlib
    import hmac

    assert value(spark, contact.hmac_sha256(F.lit("phones:1"), "key")) == hmac.new(b"key", b"phones:1", hashlib.sha256).hexdigest()


def test_feedback_is_judged_and_counted(spark):
    row = ("2024-01-01 10:00:00", "org", "consumer", "p1", None, "phone", "216-444-2200", "correct", None)
    bad = [row[:7] + ("incorrect", None), row[:7] + ("incorrect", "wrong_rating"), row[:3] + (None, None) + row[5:], row[:6] + ("555-0100",) + row[7:]]
    events = spark.createDataFrame([row, row, row[:7] + ("incorrect", "wrong_phone"), *bad], "ts string, broker_org_id string, submitter_class string, provider_id string, provider_npi string, fact_type string, fact_value string, validation_status string, reason_code string")
    valid, refused = rollups.feedback_rows(events)
    assert sorted(r["feedback_count"] for r in rollups.feedback_rollup(valid).collect()) == [1, 2]
    votes = rollups.consensus_rollup(valid).collect()
    assert [(v["positive_count"], v["negative_count"]) for v in votes] == [(2, 1)]
    assert sorted(r["reject_reason"] for r in refused.collect()) == ["PROVIDER_REQUIRED", "REASON_NOT_ALLOWED", "REASON_REQUIRED", "UNSAFE_PHONE_VALUE"]


def test_jobs_fold_summary_and_expiry(spark):
    asked = spark.createDataFrame([("r", 0, None, "1111111111", "Ada"), ("r", 1, None, None, "Bo")], "request_id string, ordinal int, providerId string, npi string, name string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    first = jobs.initial_jobs(asked)
    events = spark.createDataFrame([("r", "0:npi:1111111111", 1, "searching", None), ("r", "0:npi:1111111111", 2, "failed", "x" * 300)], "request_id string, provider_key string, seq int, status string, error string")
    events = events.withColumn("startedAt", F.lit(None).cast("timestamp")).withColumn("completedAt", F.lit(None).cast("timestamp"))
    state = jobs.fold_events(first, events)
    got = {r["provider_key"]: r for r in state.collect()}
    assert got["0:npi:1111111111"]["status"] == "failed" and len(got["0:npi:1111111111"]["error"]) == 255 and not got["0:npi:1111111111"]["loading"]
    s = jobs.summarize(state, "request_id").first()
    assert (s["total"], s["failed"], s["running"], s["job_status"]) == (2, 1, 1, "running")
    keys = spark.createDataFrame([("r",), ("none",)], "request_id string")
    late = jobs.read_jobs(keys, state.limit(1), F.lit("2024-01-02").cast("timestamp"))
    assert {r["status"] for r in late.collect()} == {"expired"}


def test_scores_by_hand(spark):
    cases = spark.createDataFrame([("c", "phones"), ("d", "phones")], "case string, field string")
    gold = spark.createDataFrame([("c", "phones", "1", "confirmed_current", True, None), ("c", "phones", "2", "confirmed_current", True, None), ("c", "phones", None, "unsafe_personal", False, "h")], "case string, field string, value string, status string, display_safe boolean, value_hash string")
    shown = spark.createDataFrame([("c", "phones", 0, "1", True), ("c", "phones", 1, "1", False), ("c", "phones", 2, "3", True)], "case string, field string, ordinal int, value string, cited boolean")
    got = {r["case"]: r for r in evaluation.score_fields(cases, gold, shown, "case", "key").collect()}
    c = got["c"]
    assert [c[k] for k in evaluation.COUNTERS] == [1, 3, 2, 2, 1, 1, 2, 0]
    assert [got["d"][k] for k in evaluation.COUNTERS] == [0] * 8
    # Without a key the job fails, not the plan: nothing is read before it runs.
    plan = evaluation.score_fields(cases, gold, shown, "case")
    with pytest.raises(Exception, match="a key is required to score unsafe facts"):
        plan.select("emitted").collect()
    assert evaluation.score_fields(cases, gold.where("status <> 'unsafe_personal'"), shown, "case").count() == 2


def test_validation(spark):
    rows = spark.createDataFrame([(None, "123", "Ada", None, None), (None, None, "A", None, None), (None, None, "Ada", "ia", None), (None, "1234567890", "Ada", "IA", "50010")], "providerId string, npi string, name string, state string, zip string")
    error = validation.request_error(*map(F.col, rows.columns))
    assert [r[0] for r in rows.select(error).collect()] == ["BAD_NPI", "BAD_NAME", "BAD_STATE", None]
    assert validation.enforce(rows, error, False).count() == 1
    assert value(spark, validation.unknown_keys(F.lit('{"a":1,"b":2}'), ["a"])) == ["b"]


def test_usage_cost_and_summary(spark):
    from factmill.operators import coerce

    raw = spark.createDataFrame([(1, response(PROFILE))], "id long, body string").select("id", coerce.usage(F.try_parse_json("body")).alias("u")).select("id", "u.*")
    got = usage.with_costs(raw, {"version": "v", "input": 1.0, "cached": 1.0, "cache_write": 1.0, "output": 1.0, "search": 1.0}).first()
    assert got["uncachedInputTokens"] == 6 and got["estimated"] and abs(got["total_usd"] - 13e-6) < 1e-12


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"a","n":1}\n\n{"k":"b","n":2}\n')
    got = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "k string, n long")
    assert got.count() == 2
    (tmp_path / "one.json").write_text('{\n "k": "z",\n "n": 3}')
    (tmp_path / "list.txt").write_text(f"{tmp_path}/one.json\n\n")
    assert files.read_manifest(spark, str(tmp_path / "list.txt"), "k string, n long").first()["n"] == 3


def test_stream_counts_like_batch(spark, tmp_path):
    rows = spark.createDataFrame([("org", "", "p", "2164442200", i % 2) for i in range(6)], "broker_org_id string, provider_npi string, provider_id string, normalized_phone string, d int").withColumn("click_day", F.date_add(F.lit("2024-01-01").cast("date"), "d")).drop("d")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = {}
    counters.stream_rollup(stream, rollups.click_rollup, lambda df, _: seen.update({r["click_day"]: r["click_count"] for r in df.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen.values()) == [3, 3]
    out = str(tmp_path / "out")
    counters.stream_counts(stream, rollups.click_rollup, rollups.CLICK_KEYS, ["click_count"], "click_day", out, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["click_count"] for r in counter_table.read_counts(spark, out, rollups.CLICK_KEYS, ["click_count"]).collect()) == [3, 3]
