"""Row checks as reject reasons: requests, profiles, cases. Null means valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.text import trimmed, units

# Fixed values.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
NPI = r"^\d{10}$"
GOLD_STATUS = ["confirmed_current", "confirmed_stale", "conflict_unresolved", "not_found", "unsafe_personal", "not_applicable"]
SOURCE_KINDS = ["cms", "nppes", "provider_official", "rating_directory", "approved_directory"]
EDGE_CASES = ["multi_location", "common_name", "recent_change", "sparse_web", "rating_directory_listed", "known_conflict"]
PROVIDER_STATUS = ["queued", "searching", "completed", "no_results", "failed", "expired"]
JOB_STATUS = ["queued", "running", "completed", "failed", "expired"]
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
#: Longest texts of a profile's parts.
MOST = {"value": 500, "rating": 80, "sourceId": 80, "sourceName": 255, "name": 255, "city": 120, "state": 2, "zip": 10, "url": 2048}


def _optional(c: Column, test: Column) -> Column:
    return c.isNull() | test


def length_between(c: Column, least: int, most: int) -> Column:
    """Whether a text is there and, trimmed, so long. A text of no more bytes that begins with a sign of ASCII needs no
    trimming to tell."""
    measured = units(trimmed(c)).between(least, most)
    if least > 1:
        return F.coalesce(measured, F.lit(False))
    begun = F.ascii(c).between(33, 126) if least == 1 else F.lit(True)
    return F.coalesce(F.when((F.octet_length(c) <= most) & begun, True).otherwise(measured), F.lit(False))


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(trimmed(c).rlike(pattern), F.lit(False))


def _among(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def is_datetime(c: Column) -> Column:
    """Whether a text is a moment in UTC as ISO 8601 has it."""
    return F.coalesce(c.rlike(DATETIME), F.lit(False)) & F.try_to_timestamp(c).isNotNull()


def _every(items: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a test holds for all; of null and of none it does."""
    return F.coalesce(F.forall(items, test), F.lit(True))


def first_error(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; null for none. A rule is what must hold."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        out = F.when(~holds, name).otherwise(out)
    return out


def request_error(providerId: Column, npi: Column, name: Column, state: Column, zip_: Column, specialty: Column | None = None, city: Column | None = None) -> Column:
    short = lambda c: F.lit(True) if c is None else _optional(c, length_between(c, 1, 255))
    return first_error(
        (_optional(npi, _matches(npi, NPI)), "BAD_NPI"), (length_between(name, 2, 255), "BAD_NAME"), (_optional(state, _matches(state, "^[A-Z]{2}$")), "BAD_STATE"), (_optional(zip_, _matches(zip_, r"^\d{5}$")), "BAD_ZIP"),
        (short(providerId), "BAD_PROVIDER_ID"), (short(specialty), "BAD_SPECIALTY"), (short(city), "BAD_CITY"),
    )


def batch_error(providers: Column) -> Column:
    return F.when(~F.coalesce(F.size(providers).between(1, 10), F.lit(False)), "BAD_BATCH_SIZE")


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object beside the allowed ones."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def fact_error(f: Column, longest: int) -> Column:
    return first_error((length_between(f["value"], 1, longest), "BAD_VALUE"), (length_between(f["sourceId"], 1, MOST["sourceId"]), "FACT_WITHOUT_SOURCE"), (_optional(f["sourceName"], length_between(f["sourceName"], 1, MOST["sourceName"])), "BAD_SOURCE_NAME"))


def source_error(s: Column) -> Column:
    return first_error(
        (length_between(s["id"], 1, MOST["sourceId"]), "BAD_SOURCE_ID"), (length_between(s["title"], 1, MOST["name"]), "BAD_SOURCE_TITLE"), (length_between(s["domain"], 1, MOST["name"]), "SOURCE_WITHOUT_DOMAIN"), (_optional(s["url"], length_between(s["url"], 0, MOST["url"])), "BAD_SOURCE_URL")
    )


def profile_error(p: Column) -> Column:
    """Why a typed profile (coerce.profile) is refused; null where it is valid. Every fact needs a value and a source id,
    every source an id, a title and a domain; lengths are bounded."""
    upto = lambda c, n: _optional(c, length_between(c, 0, n))
    place = lambda f: first_error(
        (length_between(f["addressLine1"], 1, MOST["name"]), "BAD_ADDRESS"), (upto(f["addressLine2"], MOST["name"]), "BAD_ADDRESS"), (upto(f["city"], MOST["city"]), "BAD_CITY"), (upto(f["state"], MOST["state"]), "BAD_STATE"), (upto(f["zip"], MOST["zip"]), "BAD_ZIP"),
        (length_between(f["sourceId"], 1, MOST["sourceId"]), "FACT_WITHOUT_SOURCE"), (_optional(f["sourceName"], length_between(f["sourceName"], 1, MOST["sourceName"])), "BAD_SOURCE_NAME"),
    )
    fact = lambda f: fact_error(f, MOST["value"])
    rating = lambda f: first_error((fact_error(f, MOST["rating"]).isNull(), "BAD_RATING"), (upto(f["scale"], MOST["rating"]), "BAD_SCALE"))
    own = first_error((_optional(p["providerId"], length_between(p["providerId"], 1, 255)), "BAD_PROVIDER_ID"), (_optional(p["npi"], _matches(p["npi"], NPI)), "BAD_NPI"), (length_between(p["providerName"], 1, 255), "BAD_NAME"))
    first = lambda items, error: F.get(F.filter(F.transform(items, error), lambda e: e.isNotNull()), 0)
    facts = F.concat(*(F.coalesce(p[c], F.array().cast("array<struct<value: string, sourceId: string, sourceName: string>>")) for c in ("specialties", "phoneNumbers", "websites", "publicInsuranceMentions")))
    return F.coalesce(own, first(facts, fact), first(p["locations"], place), first(p["ratings"], rating), first(p["sources"], source_error))


def gold_error(status: Column, value: Column, value_hash: Column, display_safe: Column) -> Column:
    """An unsafe fact is known by its hash alone; a confirmed or disputed one has a value."""
    unsafe = status == "unsafe_personal"
    return first_error(
        (_among(status, GOLD_STATUS), "BAD_STATUS"), (display_safe.isNotNull(), "BAD_DISPLAY_SAFE"), (_optional(value, length_between(value, 1, 1000)), "BAD_VALUE"), (_optional(value_hash, value_hash.rlike("^[a-f0-9]{64}$")), "BAD_HASH"),
        (~(unsafe & (value.isNotNull() | value_hash.isNull() | display_safe)), "UNSAFE_FACT_EXPOSED"), (~(status.isin("confirmed_current", "confirmed_stale", "conflict_unresolved") & value.isNull()), "VALUE_REQUIRED"),
    )


def evidence_error(s: Column) -> Column:
    """Why a source of a gold fact is refused."""
    return first_error((_among(s["kind"], SOURCE_KINDS), "BAD_SOURCE_KIND"), (length_between(s["domain"], 3, 255), "BAD_SOURCE_DOMAIN"), (is_datetime(s["capturedAt"]), "BAD_CAPTURED_AT"), (length_between(s["evidenceId"], 1, 255), "BAD_EVIDENCE_ID"))


CASE_SCHEMA = """schemaVersion int, caseId string, request struct<providerId: string, npi: string, name: string, specialty: string, city: string, state: string, zip: string>,
strata struct<entityType: string, region: string, rurality: string, specialtyGroup: string, edgeCases: array<string>, productionWeight: double>,
cmsBaseline struct<capturedAt: string, providerId: string, name: string, specialty: string, address: string>,
gold struct<identity: struct<npi: string, entityType: string>, {}>""".format(
    ", ".join(f"{f}: array<struct<value: string, valueHash: string, status: string, displaySafe: boolean, sources: array<struct<kind: string, domain: string, capturedAt: string, evidenceId: string>>>>" for f in ("phones", "addresses", "websites", "ratings"))
)


def case_error(c: Column) -> Column:
    """Why a case (a struct of CASE_SCHEMA) is refused; null where it is valid."""
    r, strata, base, gold = c["request"], c["strata"], c["cmsBaseline"], c["gold"]
    short = lambda x, n=120: length_between(x, 1, n)
    fact = lambda f: F.coalesce(gold_error(f["status"], f["value"], f["valueHash"], f["displaySafe"]), F.when(f["sources"].isNull() | (F.size(f["sources"]) > 10), "BAD_SOURCES"), F.get(F.filter(F.transform(f["sources"], evidence_error), lambda e: e.isNotNull()), 0))
    rules = first_error(
        (F.coalesce(c["schemaVersion"] == 1, F.lit(False)), "BAD_VERSION"), (short(c["caseId"]), "BAD_CASE_ID"), (_among(strata["entityType"], ["individual", "facility"]), "BAD_ENTITY_TYPE"), (short(strata["region"]), "BAD_REGION"), (_among(strata["rurality"], ["urban", "rural"]), "BAD_RURALITY"),
        (short(strata["specialtyGroup"]), "BAD_SPECIALTY_GROUP"), (F.coalesce(F.size(strata["edgeCases"]) <= 6, F.lit(False)) & _every(strata["edgeCases"], lambda e: _among(e, EDGE_CASES)), "BAD_EDGE_CASES"), (_optional(strata["productionWeight"], strata["productionWeight"] > 0), "BAD_WEIGHT"),
        (is_datetime(base["capturedAt"]), "BAD_CAPTURED_AT"), (short(base["providerId"], 255) & short(base["name"], 255), "BAD_BASELINE"), (_optional(base["specialty"], short(base["specialty"], 255)) & _optional(base["address"], short(base["address"], 1000)), "BAD_BASELINE"),
        (_matches(gold["identity"]["npi"], NPI), "BAD_GOLD_NPI"), (_among(gold["identity"]["entityType"], ["individual", "facility"]), "BAD_ENTITY_TYPE"), *((gold[f].isNotNull(), "GOLD_REQUIRED") for f in ("phones", "addresses", "websites", "ratings")),
    )
    facts = (F.get(F.filter(F.transform(gold[f], fact), lambda e: e.isNotNull()), 0) for f in ("phones", "addresses", "websites", "ratings"))
    return F.coalesce(rules, request_error(r["providerId"], r["npi"], r["name"], r["state"], r["zip"], r["specialty"], r["city"]), *facts)


def provider_job_error(j: Column) -> Column:
    """Why one provider's job is refused."""
    moment = lambda c: _optional(c, is_datetime(c))
    return first_error(
        (length_between(j["requestProviderKey"], 1, 320), "BAD_KEY"), (_optional(j["providerId"], length_between(j["providerId"], 1, 255)), "BAD_PROVIDER_ID"), (_optional(j["npi"], _matches(j["npi"], NPI)), "BAD_NPI"), (length_between(j["providerName"], 1, 255), "BAD_NAME"),
        (_among(j["status"], PROVIDER_STATUS), "BAD_STATUS"), (j["loading"].isNotNull(), "BAD_LOADING"), (moment(j["startedAt"]) & moment(j["completedAt"]), "BAD_TIME"), (_optional(j["error"], length_between(j["error"], 1, 255)), "BAD_ERROR"),
    )


def summary_error(s: Column) -> Column:
    counts = [F.coalesce(s[k] >= 0, F.lit(False)) for k in ("total", "completed", "noResults", "failed", "running")]
    return first_error(*((c, "BAD_SUMMARY") for c in counts))


def job_error(j: Column) -> Column:
    """Why a whole job is refused: requestId, status, expiresAt, optional providerJobs, summary and error."""
    own = first_error((is_uuid(j["requestId"]), "BAD_REQUEST_ID"), (_among(j["status"], JOB_STATUS), "BAD_STATUS"), (is_datetime(j["expiresAt"]), "BAD_EXPIRY"), (_optional(j["error"], length_between(j["error"], 1, 255)), "BAD_ERROR"))
    parts = F.get(F.filter(F.transform(j["providerJobs"], provider_job_error), lambda e: e.isNotNull()), 0)
    return F.coalesce(own, parts, F.when(j["summary"].isNotNull(), summary_error(j["summary"])))


def enforce(df: DataFrame, error: Column, strict: bool) -> DataFrame:
    """strict: an invalid row fails the job. Else it is dropped."""
    judged = df.withColumn("_e", error)
    if strict:
        judged = judged.withColumn("_e", F.when(F.col("_e").isNotNull(), F.raise_error(F.col("_e"))).cast("string"))
    return judged.where("_e is null").drop("_e")
