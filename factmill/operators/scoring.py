"""A whole evaluation: cases and observations from files to the three reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.contact import format_location
from factmill.operators import evaluation
from factmill.sources.files import read_cases, read_manifest, write_records, write_report, written

_FACT = "array<struct<value: string, sourceId: string, sourceName: string>>"
OBSERVATION_SCHEMA = f"""schemaVersion int, caseId string, repeat int, startedAt string, completedAt string, latencyMs long, terminalStatus string,
profile struct<providerId: string, npi: string, providerName: string, specialties: {_FACT}, phoneNumbers: {_FACT}, websites: {_FACT}, publicInsuranceMentions: {_FACT},
locations: array<struct<addressLine1: string, addressLine2: string, city: string, state: string, zip: string, sourceId: string, sourceName: string>>,
ratings: array<struct<value: string, scale: string, sourceId: string, sourceName: string>>, sources: array<struct<id: string, title: string, domain: string, url: string>>>, errorCode string"""


def score_observations(cases: DataFrame, observations: DataFrame, hmac_key: str | None = None) -> dict[str, DataFrame]:
    """cases: rows of CASE_SCHEMA, of which the last of each caseId counts. observations: rows of OBSERVATION_SCHEMA; rows
    that repeat are observations each. An observation of no case fails the job, as do unsafe facts without a key.

    Returns case_scores (a row for each observation, with COUNTERS by field), aggregate (a row of ratios over all of them),
    field_scores (a row of ratios for each field) and repeat_variance (a row for each case).
    """
    seen = observations.select("caseId", "latencyMs", "terminalStatus", "profile").withColumn("obs", F.monotonically_increasing_id())
    known = cases.select("caseId", F.monotonically_increasing_id().alias("line"), F.col("request.name").alias("asked_name"), F.col("gold"), F.col("cmsBaseline.address").alias("baseline_address"))
    met = written(evaluation.join_cases(seen, known, "caseId", "line"), "observations")

    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"gold.{f}").alias("facts")) for f in evaluation.FIELDS))
    held = met.select("obs", F.explode(each).alias("g")).select("obs", "g.field", F.explode_outer("g.facts").alias("x"))
    value = evaluation.normalized_value(F.col("field"), F.col("x.value"))
    gold = held.where("x is not null").select("obs", "field", F.when(F.coalesce("x.value", F.lit("")) != "", value).alias("value"), F.col("x.status").alias("status"), F.col("x.displaySafe").alias("display_safe"), F.col("x.valueHash").alias("value_hash"))
    emitted = written(evaluation.emitted_facts(met.where("profile is not null").select("obs", "caseId", "profile.*"), ["obs", "caseId"]), "emitted")
    shown = emitted.withColumn("value", evaluation.normalized_value(F.col("field"), F.col("value"))).drop("caseId")
    fields = written(evaluation.score_fields(held.select("obs", "field"), gold, shown, "obs", hmac_key), "fields")

    first = F.get("profile.locations", F.lit(0))
    address = F.when(first.isNotNull(), format_location(first["addressLine1"], first["addressLine2"], first["city"], first["state"], first["zip"]))
    observed = met.select(
        "obs", F.col("terminalStatus").alias("status"), F.col("latencyMs").alias("latency_ms"), F.col("profile.npi").alias("npi"), F.col("profile.providerName").alias("provider_name"), address.alias("address"), F.col("profile").isNotNull().alias("present"),
        F.col("gold.identity.npi").alias("gold_npi"), "asked_name", "baseline_address",
    )
    judged = written(evaluation.score_cases(observed, "obs"), "judged")
    by_field = fields.groupBy("obs").pivot("field", evaluation.FIELDS).agg(F.first(F.struct(*evaluation.COUNTERS)))
    repeats = evaluation.repeats_of(emitted.withColumnRenamed("obs", "repeat"), met.select("caseId", F.col("obs").alias("repeat")), "caseId")
    return {
        "case_scores": met.select("obs", "caseId").join(judged, "obs").join(by_field, "obs").drop("obs"),
        "aggregate": evaluation.case_overview(judged),
        "field_scores": evaluation.aggregate_scores(fields),
        "repeat_variance": evaluation.repeat_variance(repeats, "caseId"),
    }


def score_files(spark: SparkSession, cases: str, manifest: str, out: str, hmac_key: str | None = None) -> None:
    """cases: JSON lines; manifest: a text file of paths of observations. Writes folders under out: case-scores and
    repeat-variance with a JSON line for each row, aggregate with one document, which holds the ratios of all fields."""
    found = score_observations(read_cases(spark, cases), read_manifest(spark, manifest, OBSERVATION_SCHEMA), hmac_key)
    write_records(found["case_scores"], f"{out}/case-scores")
    # Four rows and one.
    fields = found["field_scores"].agg(F.array_sort(F.collect_list(F.struct("*"))).alias("fields")).withColumn("one", F.lit(1))
    write_report(found["aggregate"].withColumn("one", F.lit(1)).join(fields, "one").drop("one"), f"{out}/aggregate")
    write_records(found["repeat_variance"], f"{out}/repeat-variance/cases")
    write_report(evaluation.mean_variance(found["repeat_variance"]), f"{out}/repeat-variance/means")
