"""Scalar operators on inputs written out here, each with the value that must come out, dealt over the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import contact, settings, stats, text, urls
from factmill.operators import coerce, evaluation, jobs, profiles, rollups, usage, validation
from factmill.plans.registry import query, table

Cell = str | bool | int | float | None


def _sql(v: Cell) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def outcomes(**columns: list[Cell]) -> str:
    """SQL of one row for each customer: of each list the entry that the customer's number falls on."""
    picks = (f"([{', '.join(map(_sql, values))}])[c_custkey % {len(values)} + 1] AS {name}" for name, values in columns.items())
    return f"SELECT c_custkey, {', '.join(picks)} FROM customer"


def dealt(spark: SparkSession, sf_dir: str, **inputs: list[Cell]) -> DataFrame:
    """Each customer with the entry of each list that its number falls on, computed once."""
    k = F.col("c_custkey")
    picked = (F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int")).alias(name) for name, values in inputs.items())
    return profiles.settled(table(spark, sf_dir, "customer").select("c_custkey", *picked))


URLS = {
    "https://www.Clinic.com:443/a/../b c?q=b%20c&%75tm_source=1&a=1#x": ("https://www.clinic.com/b%20c?a=1&q=b+c", "clinic.com", "clinic.com/b%20c?a=1&q=b+c"),
    "http:\\\\clinic.com\\é\\?x&&y=%zz": ("http://clinic.com/%C3%A9/?x=&y=%25zz", "clinic.com", "clinic.com/%c3%a9?x=&y=%25zz"),
    "ftp://clinic.com/a": (None, "clinic.com", None), "https://u:p@clinic.com/": (None, "clinic.com", None), "http://clinic.com:8080/A/": ("http://clinic.com:8080/A/", "clinic.com", "clinic.com/a"),
    "http://exa mple.com/": (None, "fall.back.org", None), "http://example.com/": (None, "public-source", None), "https://a.test": (None, "public-source", None), "https://clinic.com:99999/": (None, "clinic.com", None),
    "no url": (None, "fall.back.org", None), "": (None, "fall.back.org", None), "https://clinic.com?ref=1&b=2&a=2&a=1": ("https://clinic.com/?a=2&a=1&b=2", "clinic.com", "clinic.com/?a=2&a=1&b=2"),
    "https://sub.clinic.com/./x/%2E%2e/y/.": ("https://sub.clinic.com/y/", "sub.clinic.com", "sub.clinic.com/y"), "http://localhost/": (None, "public-source", None), "http://clinic.com/<a>\"": ("http://clinic.com/%3Ca%3E%22", "clinic.com", "clinic.com/%3ca%3e%22"),
}


@query(outcomes(canonical=[v[0] for v in URLS.values()], domain=[v[1] for v in URLS.values()], website=[v[2] for v in URLS.values()]))
def url_cases(spark, sf_dir):
    """Urls as browsers read and write them, their domains and keys."""
    u = F.col("u")
    rows = dealt(spark, sf_dir, u=list(URLS))
    return rows.select("c_custkey", urls.safe_public_url(u).alias("canonical"), urls.safe_domain(F.lit("fall.back.org"), u).alias("domain"), urls.website_key(u).alias("website"))


TEXTS = {
    "José": "jose", "Joséphine  Müller": "jose phine mu ller", "ﬁne ½ №5 Ⅷ": "fine 1 2 no5 viii", "ＡＢＣ１": "abc1", "ß ø x": "x", "İzmir": "i zmir", "": "", "Dr. O'Neil, M.D.": "dr o neil m d", None: "",
}


@query(outcomes(plain=list(TEXTS.values())))
def plain_text_cases(spark, sf_dir):
    """Compatibility decomposition: a mark ends a word."""
    return dealt(spark, sf_dir, t=list(TEXTS)).select("c_custkey", text.plain_text(F.col("t")).alias("plain"))


PHONES = {"1 (216) 444-2200 ext. 12": ("2164442200", "12", "2164442200x12"), "216.444.2200x9": ("2164442200", "9", "2164442200x9"), "+1 216 444 2200": ("2164442200", None, "2164442200"), "44 20 7946": ("44207946", None, "44207946"), "none": ("", None, "")}
ADDRESSES = {"12 North Main Street, Suite 5, Ames, IA 50010-1234": ("12 n main st ste 5 ames ia 50010 1234", "50010"), "9 Oak Avenue": ("9 oak ave", None), "1 Côte Road 123456": ("1 co te rd 123456", None)}


@query(outcomes(digits=[v[0] for v in PHONES.values()], extension=[v[1] for v in PHONES.values()], key=[v[2] for v in PHONES.values()], address=[v[0] for v in ADDRESSES.values()], zip=[v[1] for v in ADDRESSES.values()]))
def contact_cases(spark, sf_dir):
    """Phones with extensions, addresses with short words and zip codes."""
    rows = dealt(spark, sf_dir, p=list(PHONES), a=list(ADDRESSES))
    phone, place = contact.phone_parts(F.col("p")), contact.address_parts(F.col("a"))
    return rows.select("c_custkey", phone["digits"].alias("digits"), phone["extension"].alias("extension"), contact.phone_key(F.col("p")).alias("key"), place["canonical"].alias("address"), place["zip"].alias("zip"))


FIELDS = [("phones", "216 444 2200 x7", "2164442200x7"), ("addresses", "9 Oak Avenue", "9 oak ave"), ("websites", "https://www.clinic.com/A/", "clinic.com/a"), ("websites", "nothing", ""), ("ratings", "4.5/5", "4 5 5")]


@query(outcomes(value=[v for _, _, v in FIELDS]))
def normalized_value_cases(spark, sf_dir):
    """Facts of each field as they are compared."""
    rows = dealt(spark, sf_dir, f=[f for f, _, _ in FIELDS], v=[v for _, v, _ in FIELDS])
    return rows.select("c_custkey", evaluation.normalized_value(F.col("f"), F.col("v")).alias("value"))


JSON = {
    '"a"': ("a", 1, True), "4.50": ("4.5", 1, True), "12": ("12", 1, True), "true": (None, 1, True), "null": (None, 0, False), '""': ("", 0, False), "0": ("0", 0, False), '"0"': ("0", 1, True), "[]": (None, 0, True), "[1, 2]": (None, 2, True),
    '{"name": "n", "text": ""}': ("n", 1, True), '{"value": {"content": {"label": "deep"}}, "title": "t"}': ("deep", 1, True), '{"value": false, "title": {"other": 1}}': (None, 1, True), "false": (None, 0, False),
}


@query(outcomes(text=[v[0] for v in JSON.values()], items=[v[1] for v in JSON.values()], truthy=[v[2] for v in JSON.values()]))
def coercion_cases(spark, sf_dir):
    """Loose values as texts and as lists."""
    v = F.try_parse_json("j")
    return dealt(spark, sf_dir, j=list(JSON)).select("c_custkey", coerce.coerce_string(v).alias("text"), F.size(coerce.items(v)).alias("items"), coerce.truthy(v).alias("truthy"))


ENTRIES = [
    ('{"phone": "1", "source": {"id": "s"}, "sourceName": "n"}', "1", "s", "n"), ('{"url": "u", "source_id": 7, "source_name": "m"}', "u", "7", "m"), ('{"text": "t", "source": {"sourceId": "z", "label": "l"}}', "t", "z", "l"),
    ('"bare"', "bare", None, None), ('{"number": 5}', "5", "public-source", None), ('{"other": 5}', None, None, None),
]


@query(outcomes(value=[e[1] for e in ENTRIES], source_id=[e[2] for e in ENTRIES], source_name=[e[3] for e in ENTRIES]))
def fact_coercion_cases(spark, sf_dir):
    """Facts in their many spellings; what has no value is dropped."""
    f = F.get(coerce.facts(F.try_parse_json("j")), 0)
    return dealt(spark, sf_dir, j=[e[0] for e in ENTRIES]).select("c_custkey", f["value"].alias("value"), f["sourceId"].alias("source_id"), f["sourceName"].alias("source_name"))


PLACES = [
    ('{"street1": "1 A", "zipCode": "5", "source": {"id": "s"}}', "1 A", None, None, "5", "s"), ('{"addressLine1": {"text": "2 B", "sourceId": "q"}, "street2": "x", "city": "C"}', "2 B", "x", "C", None, "q"), ('"3 C"', "3 C", None, None, None, None),
    ('{"address": "4 D", "zip": 50010}', "4 D", None, None, "50010", "public-source"), ('{"city": "E"}', None, None, None, None, None),
]


@query(outcomes(line1=[p[1] for p in PLACES], line2=[p[2] for p in PLACES], city=[p[3] for p in PLACES], zip=[p[4] for p in PLACES], source_id=[p[5] for p in PLACES]))
def location_coercion_cases(spark, sf_dir):
    x = F.get(coerce.locations(F.try_parse_json("j")), 0)
    return dealt(spark, sf_dir, j=[p[0] for p in PLACES]).select("c_custkey", x["addressLine1"].alias("line1"), x["addressLine2"].alias("line2"), x["city"].alias("city"), x["zip"].alias("zip"), x["sourceId"].alias("source_id"))


FENCED = ['```json\n{"a": 1}\n```', 'so: [1, {"b": 2}] done', "nothing", '{"a": 1} and }', "```\n[]\n```"]


@query(outcomes(body=['{"a": 1}', '[1, {"b": 2}]', None, '{"a": 1} and }', "[]"], message=["from parts", "one\ntwo", None, "whole", "from parts"]))
def response_text_cases(spark, sf_dir):
    """The JSON inside a text, and the text of a response."""
    said = [
        '{"output": [{"type": "message", "content": [{"type": "output_text", "text": "from parts"}]}]}', '{"output_text": " ", "output": [{"type": "message", "content": [{"type": "output_text", "text": "one"}, {"type": "other", "text": "no"}, {"type": "output_text", "text": "two"}]}]}',
        '{"output": [{"type": "reasoning", "content": []}]}', '{"output_text": "whole", "output": []}', '{"output_text": 5, "output": [{"type": "message", "content": {"type": "output_text", "text": "from parts"}}]}',
    ]
    rows = dealt(spark, sf_dir, t=FENCED, r=said)
    return rows.select("c_custkey", coerce.json_text(F.col("t")).alias("body"), coerce.response_text(F.try_parse_json("r")).alias("message"))


_SETTINGS = ["1", "TRUE", "yes", "off", "", None, "12.5", "-3", "abc", " 7 ", "1e3", "Infinity"]


@query(outcomes(flag=[True, True, True, False, False, False, False, False, False, False, False, False], number=[1.0, 5.0, 5.0, 5.0, 5.0, 5.0, 12.5, 5.0, 5.0, 7.0, 1000.0, 5.0], bounded=[1.0, 5.0, 5.0, 5.0, 5.0, 5.0, 10.0, 5.0, 5.0, 7.0, 10.0, 5.0], optional=[1.0, None, None, None, None, None, 12.5, None, None, 7.0, 1000.0, None]))
def settings_cases(spark, sf_dir):
    """Texts of settings as values with defaults and bounds."""
    c = F.col("s")
    return dealt(spark, sf_dir, s=_SETTINGS).select("c_custkey", settings.boolean_value(c).alias("flag"), settings.number_value(c, 5).alias("number"), settings.bounded_number_value(c, 5, 10).alias("bounded"), settings.optional_number_value(c).alias("optional"))


@query(outcomes(submitter=["consumer", "unknown", "unknown", "producer"], org=["acme", "local", "local", "acme"], seen=["bad name", "Provider profile search failed.", "Provider profile search failed.", "bad name"], npi=["1234567890", "0987654321", None, "1234567890"], ms=[3, 0, 4, 2]))
def request_defaults(spark, sf_dir):
    """Who asked, what they may see of an error, and the NPI that a request means."""
    rows = dealt(spark, sf_dir, user=["consumer", "boss", None, "producer"], sub=["acme", "", None, "acme"], status=[400, 500, None, 404], npi=["1234567890", None, None, "1234567890"], pid=["x", "0987654321", "098", None], took=[2.5, -4.2, 3.7, 2.49])
    c = F.col
    return rows.select("c_custkey", rollups.submitter_class(c("user")).alias("submitter"), rollups.broker_org(c("sub")).alias("org"), jobs.safe_job_error(c("status"), F.lit("bad name")).alias("seen"), contact.requested_npi(c("npi"), c("pid")).alias("npi"), usage.duration_ms(c("took")).cast("int").alias("ms"))


@query("""SELECT c_custkey, c_custkey || CASE c_custkey % 3 WHEN 0 THEN ':npi:1234567890' WHEN 1 THEN ':providerId:p7' ELSE ':name:ann o neil' END AS request_key, 'jobs:' || sha256('team a') || ':' || c_custkey AS job_key FROM customer""")
def job_keys(spark, sf_dir):
    """Keys of a provider's part of a job, and of a job by its owner."""
    rows = dealt(spark, sf_dir, npi=["1234567890", None, None], pid=["p7", "p7", None], name=["Ann", "Ann", " Ann O'Neil"])
    return rows.select("c_custkey", contact.request_key(F.col("c_custkey"), F.col("npi"), F.col("pid"), F.col("name")).alias("request_key"), contact.job_key("jobs", F.lit(" Team A "), F.col("c_custkey").cast("string")).alias("job_key"))


# Validation: the first rule that is broken.

_ASKED = [
    (None, "1234567890", "Ada", "IA", "50010", "BAD_NONE"), (None, "123", "Ada", None, None, "BAD_NPI"), (None, None, "A", None, None, "BAD_NAME"), (None, None, "Ada", "ia", None, "BAD_STATE"), (None, None, "Ada", None, "5001", "BAD_ZIP"), ("  ", None, "Ada", None, None, "BAD_PROVIDER_ID"),
    (None, None, None, None, None, "BAD_NAME"), (" p ", " 1234567890 ", " Ada ", " IA ", None, "BAD_NONE"),
]


@query(outcomes(error=[None if a[-1] == "BAD_NONE" else a[-1] for a in _ASKED], batch=["BAD_BATCH_SIZE", None, None, "BAD_BATCH_SIZE"], unknown=["b", ""]))
def request_errors(spark, sf_dir):
    """Requests, the size of a batch of them, and keys that none may have."""
    names = ("pid", "npi", "name", "state", "zip")
    rows = dealt(spark, sf_dir, **{n: [a[i] for a in _ASKED] for i, n in enumerate(names)}, n=[0, 1, 10, 11], j=['{"a": 1, "b": 2}', '{"a": 1}'])
    batch = F.array_repeat(F.lit(1), F.col("n"))
    return rows.select("c_custkey", validation.request_error(*map(F.col, names)).alias("error"), validation.batch_error(batch).alias("batch"), F.array_join(validation.unknown_keys(F.col("j"), ["a"]), ",").alias("unknown"))


_GOOD = '{"name": "Ada", "phones": [{"value": "1", "sourceId": "s"}], "sources": [{"id": "s", "title": "t", "domain": "d.com"}]}'
_PROFILES = {
    _GOOD: None, _GOOD.replace('"name"', '"npi": "12", "name"'): "BAD_NPI", _GOOD.replace('"Ada"', '"' + "a" * 256 + '"'): "BAD_NAME", _GOOD.replace('"value": "1"', '"value": "' + "1" * 501 + '"'): "BAD_VALUE", _GOOD.replace('{"value": "1", "sourceId": "s"}', '"1"'): "FACT_WITHOUT_SOURCE",
    _GOOD.replace('"d.com"', '"", "url": "http://d.com"'): "SOURCE_WITHOUT_DOMAIN", _GOOD.replace('"id": "s"', '"id": "' + "s" * 81 + '"'): "BAD_SOURCE_ID", _GOOD.replace('"phones"', '"ratings": {"value": "5", "scale": "' + "x" * 81 + '", "sourceId": "s"}, "phones"'): "BAD_SCALE",
    _GOOD.replace('"phones"', '"locations": {"street1": "1 A", "state": "IOWA", "sourceId": "s"}, "phones"'): "BAD_STATE", _GOOD.replace('"phones"', '"locations": [{"street1": "1 A", "zip": "50010-12345", "sourceId": "s"}], "phones"'): "BAD_ZIP", _GOOD.replace('"title": "t"', f'"title": "{"t" * 256}"'): "BAD_SOURCE_TITLE",
}


@query(outcomes(error=list(_PROFILES.values())))
def profile_errors(spark, sf_dir):
    """Typed profiles against the schema."""
    rows = profiles.settled(dealt(spark, sf_dir, j=list(_PROFILES)).select("c_custkey", coerce.profile(F.try_parse_json("j")).alias("p")))
    return rows.select("c_custkey", validation.profile_error(F.col("p")).alias("error"))


_HASH = "0" * 64
_GOLD = [
    ("confirmed_current", "v", None, True, None), ("confirmed_stale", None, None, True, "VALUE_REQUIRED"), ("conflict_unresolved", None, None, False, "VALUE_REQUIRED"), ("unsafe_personal", None, _HASH, False, None), ("unsafe_personal", "v", _HASH, False, "UNSAFE_FACT_EXPOSED"),
    ("unsafe_personal", None, _HASH, True, "UNSAFE_FACT_EXPOSED"), ("unsafe_personal", None, None, False, "UNSAFE_FACT_EXPOSED"), ("odd", "v", None, True, "BAD_STATUS"), ("not_found", None, "xyz", True, "BAD_HASH"), ("not_applicable", None, None, None, "BAD_DISPLAY_SAFE"),
]


@query(outcomes(error=[g[-1] for g in _GOLD]))
def gold_errors(spark, sf_dir):
    """Gold facts: an unsafe one shows its hash alone."""
    rows = dealt(spark, sf_dir, s=[g[0] for g in _GOLD], v=[g[1] for g in _GOLD], h=[g[2] for g in _GOLD], d=[g[3] for g in _GOLD])
    return rows.select("c_custkey", validation.gold_error(F.col("s"), F.col("v"), F.col("h"), F.col("d")).alias("error"))


_SOURCE = '{"kind": "cms", "domain": "cms.gov", "capturedAt": "2026-01-01T00:00:00Z", "evidenceId": "e"}'
_CASE = f"""{{"schemaVersion": 1, "caseId": "c", "request": {{"name": "Ada"}}, "strata": {{"entityType": "individual", "region": "r", "rurality": "urban", "specialtyGroup": "g", "edgeCases": ["common_name"]}},
"cmsBaseline": {{"capturedAt": "2026-01-01T00:00:00.5Z", "providerId": "p", "name": "n"}}, "gold": {{"identity": {{"npi": "1234567890", "entityType": "facility"}},
"phones": [{{"value": "1", "status": "confirmed_current", "displaySafe": true, "sources": [{_SOURCE}]}}], "addresses": [], "websites": [], "ratings": []}}}}"""
_CASES = {
    _CASE: None, _CASE.replace('"schemaVersion": 1', '"schemaVersion": 2'): "BAD_VERSION", _CASE.replace('"caseId": "c"', '"caseId": " "'): "BAD_CASE_ID", _CASE.replace('"urban"', '"town"'): "BAD_RURALITY", _CASE.replace('"common_name"', '"odd"'): "BAD_EDGE_CASES", _CASE.replace("00:00:00.5Z", "x"): "BAD_CAPTURED_AT",
    _CASE.replace('"npi": "1234567890"', '"npi": "1"'): "BAD_GOLD_NPI", _CASE.replace('"websites": [], ', ""): "GOLD_REQUIRED", _CASE.replace('"name": "Ada"', '"name": "A"'): "BAD_NAME", _CASE.replace('"value": "1", ', ""): "VALUE_REQUIRED", _CASE.replace('"kind": "cms"', '"kind": "blog"'): "BAD_SOURCE_KIND",
    _CASE.replace('"edgeCases"', '"productionWeight": 0, "edgeCases"'): "BAD_WEIGHT", _CASE.replace(_SOURCE, ", ".join([_SOURCE] * 11)): "BAD_SOURCES",
}


@query(outcomes(error=list(_CASES.values())))
def case_errors(spark, sf_dir):
    """Cases of an evaluation against their schema."""
    rows = profiles.settled(dealt(spark, sf_dir, j=list(_CASES)).select("c_custkey", F.from_json("j", validation.CASE_SCHEMA).alias("c")))
    return rows.select("c_custkey", validation.case_error(F.col("c")).alias("error"))


_PART = '{"requestProviderKey": "0:npi:1", "providerName": "Ada", "status": "queued", "loading": true, "startedAt": null}'
_JOB = f'{{"requestId": "7b6ed4c0-58a1-4cf0-9df8-7d4be1b6f0a1", "status": "queued", "expiresAt": "2026-01-01T00:00:00Z", "providerJobs": [{_PART}], "summary": {{"total": 1, "completed": 0, "noResults": 0, "failed": 0, "running": 1}}}}'
_JOBS = {
    _JOB: None, _JOB.replace("7b6ed4c0", "zb6ed4c0"): "BAD_REQUEST_ID", _JOB.replace('"status": "queued", "expires', '"status": "no_results", "expires'): "BAD_STATUS", _JOB.replace("2026-01-01T00:00:00Z", "tomorrow"): "BAD_EXPIRY", _JOB.replace('"failed": 0', '"failed": -1'): "BAD_SUMMARY", _JOB.replace('"loading": true, ', ""): "BAD_LOADING",
    _JOB.replace('"startedAt": null', '"startedAt": "2026-13-01T00:00:00Z"'): "BAD_TIME", _JOB.replace('"0:npi:1"', '""'): "BAD_KEY",
}
JOB_SCHEMA = "requestId string, status string, expiresAt string, error string, providerJobs array<struct<requestProviderKey: string, providerId: string, npi: string, providerName: string, status: string, loading: boolean, startedAt: string, completedAt: string, error: string>>, summary struct<total: long, completed: long, noResults: long, failed: long, running: long>"


@query(outcomes(error=list(_JOBS.values())))
def job_errors(spark, sf_dir):
    """Jobs against their schema."""
    rows = profiles.settled(dealt(spark, sf_dir, j=list(_JOBS)).select("c_custkey", F.from_json("j", JOB_SCHEMA).alias("c")))
    return rows.select("c_custkey", validation.job_error(F.col("c")).alias("error"))


_FEEDBACK = [
    ("org", "consumer", "p", None, "phone", "216-444-2200", "correct", None, None), ("org", "consumer", "p", None, "phone", "216-444-2200", "incorrect", None, "REASON_REQUIRED"), ("org", "consumer", "p", None, "phone", "216-444-2200", "incorrect", "wrong_rating", "REASON_NOT_ALLOWED"),
    ("org", "consumer", "p", None, "phone", "216-444-2200", "correct", "outdated", "REASON_NOT_ALLOWED"), ("org", "consumer", None, None, "phone", "216-444-2200", "correct", None, "PROVIDER_REQUIRED"), ("", "consumer", "p", None, "phone", "1", "correct", None, "BAD_ORG"), ("org", "guest", "p", None, "phone", "1", "correct", None, "BAD_SUBMITTER"),
    ("org", "unknown", "p", "12", "phone", "1", "correct", None, "BAD_PROVIDER"), ("org", "unknown", "p", None, "fax", "1", "correct", None, "BAD_FACT_TYPE"), ("org", "unknown", "p", None, "phone", "555-0100", "correct", None, "UNSAFE_PHONE_VALUE"), ("org", "unknown", "p", None, "phone", "12", "correct", None, "INVALID_PHONE_VALUE"),
    ("org", "unknown", "p", None, "website", "https://clinic.com/?utm_x=1", "incorrect", "wrong_website", None), ("org", "unknown", "p", None, "website", "ftp://clinic.com", "correct", None, "UNSAFE_FACT_VALUE"), ("org", "unknown", "p", None, "profile", "a client said", "correct", None, "UNSAFE_FACT_VALUE"), ("org", "unknown", "p", None, "profile", " ", "correct", None, "BAD_VALUE"),
    ("org", "unknown", "p", None, "address", " 1 Main\tSt ", "incorrect", "wrong_location", None),
]
_CLEANED = {"216-444-2200": "216-444-2200", "https://clinic.com/?utm_x=1": "https://clinic.com/", " 1 Main\tSt ": "1 Main St"}


@query(outcomes(error=[f[-1] for f in _FEEDBACK], value=[_CLEANED[f[5]] if f[-1] is None else None for f in _FEEDBACK]))
def feedback_errors(spark, sf_dir):
    """Feedback of every kind, valid or not."""
    names = ("broker_org_id", "submitter_class", "provider_id", "provider_npi", "fact_type", "fact_value", "validation_status", "reason_code")
    rows = dealt(spark, sf_dir, **{n: [f[i] for f in _FEEDBACK] for i, n in enumerate(names)}).withColumn("ts", F.timestamp_seconds("c_custkey"))
    return rollups.judge_feedback(rows).select("c_custkey", F.col("reject_reason").alias("error"), F.col("cleaned").alias("value"))


_CLICKS = [("org", "p", None, "216-444-2200", None), ("", "p", None, "216-444-2200", "BAD_ORG"), ("org", None, "12", "216-444-2200", "BAD_PROVIDER"), ("org", None, None, "216-444-2200", "PROVIDER_REQUIRED"), ("org", None, "1234567890", "216", "BAD_PHONE")]


@query(outcomes(error=[c[-1] for c in _CLICKS]))
def click_errors(spark, sf_dir):
    names = ("org", "pid", "npi", "phone")
    rows = dealt(spark, sf_dir, **{n: [c[i] for c in _CLICKS] for i, n in enumerate(names)})
    return rows.select("c_custkey", rollups.click_error(*map(F.col, names)).alias("error"))


_SOURCES = [
    ("Eastside Clinic", "eastside.com", "https://eastside.com", 0), ("Eastside Clinic", "eastside.com", None, 99), ("Eastside", "cms.gov", "u", 1), ("Eastside", "data.cms.gov", "u", 1), ("Eastside Clinic", "zocdoc.com", "u", 2), ("Eastside Clinic", "m.facebook.com", "u", 99), ("People Finder Eastside", "cms.gov", "u", 99), ("West Clinic", "west.com", "u", 99),
    ("Eastside physicians", "eastside.com", "u", 99),
]


@query(outcomes(rank=[s[-1] for s in _SOURCES], rating_site=[s[1] == "zocdoc.com" for s in _SOURCES], public=[True] * len(_SOURCES)))
def source_rank_cases(spark, sf_dir):
    """Sources of a provider of one name: official, government, directory, or of no rank."""
    rows = dealt(spark, sf_dir, title=[s[0] for s in _SOURCES], domain=[s[1] for s in _SOURCES], url=[s[2] for s in _SOURCES])
    source = F.struct("title", "domain", "url")
    return rows.select("c_custkey", profiles.source_rank(source, F.lit("Dr Eastside")).alias("rank"), urls.domain_matches(F.col("domain"), profiles.RATING_SITES).alias("rating_site"), profiles.displayable(F.col("domain")).alias("public"))


@query(outcomes(low=[0.0, 0.4902, 0.0], high=[0.0, 0.9433, 0.2775], share=[None, 0.8, 0.0], cost=[0.0, 0.000012, 0.0]))
def interval_cases(spark, sf_dir):
    """Intervals to four digits, ratios, and a cost that nothing adds to."""
    rows = dealt(spark, sf_dir, s=[0, 8, 0], n=[0, 10, 10], u=[None, 6, 0])
    w = stats.wilson(F.col("s"), F.col("n"))
    cost = stats.optional_cost(F.col("u"), F.lit(2.0), 1_000_000)
    return rows.select("c_custkey", F.round(w["lower"], 4).alias("low"), F.round(w["upper"], 4).alias("high"), stats.ratio(F.col("s"), F.col("n")).alias("share"), cost.alias("cost"))
