"""Feedback and clicks: validation, cleaning, and daily counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from factmill.functions.contact import aggregation_key
from factmill.functions.text import left_units, let, safe_fact, safe_phone, units
from factmill.functions.urls import safe_public_url
from factmill.operators.profiles import settled

# Fixed values.
SUBMITTERS = ["consumer", "producer", "broker_admin", "general_agent", "internal_administrator", "unknown"]
FACT_TYPES = ["profile", "phone", "address", "website", "rating"]
COMMON_REASONS = ["outdated", "wrong_provider", "missing_info", "other"]
OWN_REASON = {"phone": "wrong_phone", "address": "wrong_location", "website": "wrong_website", "rating": "wrong_rating"}
MOST_ID = 191
FEEDBACK_KEYS = ["broker_org_id", "submitter_class", "provider_npi", "provider_id", "fact_type", "normalized_fact_value", "validation_status", "reason_code", "feedback_day"]
CONSENSUS_KEYS = ["broker_org_id", "provider_npi", "provider_id", "fact_type", "normalized_fact_value", "feedback_day"]
CLICK_KEYS = ["broker_org_id", "provider_npi", "provider_id", "normalized_phone", "click_day"]


def _bounded(c: Column, least: int, most: int) -> Column:
    return F.coalesce(units(F.trim(c)).between(least, most), F.lit(False))


def utc_day(rows: DataFrame, name: str) -> Column:
    """The day of a moment in UTC, whatever the session's zone; of a wall-clock time (TIMESTAMP_NTZ) its own day."""
    if isinstance(rows.schema[name].dataType, TimestampType):
        day = 86_400_000_000
        since = F.unix_micros(F.col(name))
        return F.date_from_unix_date(((since - F.pmod(since, F.lit(day))) / day).cast("int"))
    return F.to_date(name)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def feedback_error(fact_type: Column, status: Column, reason: Column, org: Column, submitter: Column, provider_id: Column, npi: Column, value: Column) -> Column:
    """Why a feedback event is refused; null where it is valid."""
    own = F.lit(None).cast("string")
    for kind, code in OWN_REASON.items():
        own = F.when(fact_type == kind, code).otherwise(own)
    allowed = reason.isin(*COMMON_REASONS) | F.coalesce(reason == own, F.lit(False))
    known = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    return (
        F.when(~_bounded(org, 1, 120), "BAD_ORG")
        .when(~known(submitter, SUBMITTERS), "BAD_SUBMITTER")
        .when(provider_id.isNotNull() & ~_bounded(provider_id, 1, 255) | npi.isNotNull() & ~npi.rlike(r"^\d{10}$"), "BAD_PROVIDER")
        .when(_blank(provider_id) & _blank(npi), "PROVIDER_REQUIRED")
        .when(~known(fact_type, FACT_TYPES), "BAD_FACT_TYPE")
        .when(~_bounded(value, 1, 255), "BAD_VALUE")
        .when(~known(status, ["correct", "incorrect"]), "BAD_STATUS")
        .when((status == "correct") & reason.isNotNull() & (reason != "accurate"), "REASON_NOT_ALLOWED")
        .when((status == "incorrect") & reason.isNull(), "REASON_REQUIRED")
        .when((status == "incorrect") & ~allowed, "REASON_NOT_ALLOWED")
    )


def feedback_value(fact_type: Column, value: Column) -> Column:
    """value (cleaned, null if refused) and reason: phones as phones, websites as urls, the rest as safe facts."""
    judged = lambda v: F.struct(v.alias("value"), F.when(v.isNull(), "UNSAFE_FACT_VALUE").alias("reason"))
    url = let(safe_public_url(value), lambda u: judged(F.when(units(u) <= 255, u)))
    return F.when(fact_type == "phone", safe_phone(value)).when(fact_type == "website", url).otherwise(let(safe_fact(value, 255), judged))


def judge_feedback(events: DataFrame) -> DataFrame:
    """events: ts, broker_org_id, submitter_class, provider_id, provider_npi, fact_type, fact_value, validation_status,
    reason_code. Adds cleaned (the value) and reject_reason, null for valid rows."""
    c = F.col
    error = feedback_error(c("fact_type"), c("validation_status"), c("reason_code"), c("broker_org_id"), c("submitter_class"), c("provider_id"), c("provider_npi"), c("fact_value"))
    # Settled, so that the values are cleaned once for the filter and the columns.
    judged = settled(events.withColumn("_v", feedback_value(c("fact_type"), c("fact_value"))).withColumn("reject_reason", error))
    reason = F.coalesce("reject_reason", "_v.reason")
    return judged.withColumns({"reject_reason": reason, "cleaned": F.when(reason.isNull(), c("_v.value"))}).drop("_v")


def feedback_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows of judge_feedback with FEEDBACK_KEYS, and the refused rows with reject_reason."""
    judged = judge_feedback(events)
    valid = judged.where("reject_reason is null").select(
        "broker_org_id", "submitter_class", F.coalesce("provider_npi", F.lit("")).alias("provider_npi"), F.coalesce(left_units(F.col("provider_id"), MOST_ID), F.lit("")).alias("provider_id"), "fact_type",
        F.col("cleaned").alias("normalized_fact_value"), "validation_status", F.coalesce("reason_code", F.lit("accurate")).alias("reason_code"), utc_day(judged, "ts").alias("feedback_day"),
    )
    return valid, judged.where("reject_reason is not null").drop("cleaned")


def feedback_rollup(rows: DataFrame) -> DataFrame:
    """Feedback per FEEDBACK_KEYS, with the hash of the key."""
    return rows.groupBy(*FEEDBACK_KEYS).agg(F.count(F.lit(1)).alias("feedback_count")).withColumn("aggregation_key", aggregation_key(*map(F.col, FEEDBACK_KEYS)))


def consensus_rollup(rows: DataFrame) -> DataFrame:
    """Votes for and against each fact a day."""
    fine = F.col("validation_status") == "correct"
    votes = rows.groupBy(*CONSENSUS_KEYS).agg(F.count_if(fine).alias("positive_count"), F.count_if(~fine).alias("negative_count"))
    return votes.withColumn("aggregation_key", aggregation_key(*map(F.col, CONSENSUS_KEYS)))


def click_error(org: Column, provider_id: Column, npi: Column, phone: Column) -> Column:
    """Why a click is refused; null where it is valid."""
    return (
        F.when(~_bounded(org, 1, 120), "BAD_ORG")
        .when(provider_id.isNotNull() & ~_bounded(provider_id, 1, 255) | npi.isNotNull() & ~npi.rlike(r"^\d{10}$"), "BAD_PROVIDER")
        .when(_blank(provider_id) & _blank(npi), "PROVIDER_REQUIRED")
        .when(~_bounded(phone, 7, 30), "BAD_PHONE")
    )


def click_rows(events: DataFrame) -> DataFrame:
    """events: ts, broker_org_id, provider_id, provider_npi, phone. Valid clicks with CLICK_KEYS."""
    c = F.col
    fine = events.where(click_error(c("broker_org_id"), c("provider_id"), c("provider_npi"), c("phone")).isNull())
    cleaned = settled(fine.withColumn("phone", safe_phone(c("phone"))["value"])).where("phone is not null")
    return cleaned.select("broker_org_id", F.coalesce("provider_npi", F.lit("")).alias("provider_npi"), F.coalesce(left_units(F.col("provider_id"), MOST_ID), F.lit("")).alias("provider_id"), F.col("phone").alias("normalized_phone"), utc_day(cleaned, "ts").alias("click_day"))


def submitter_class(user_class: Column) -> Column:
    """A known class of users, else ``unknown``."""
    return F.when(user_class.isin(*SUBMITTERS), user_class).otherwise("unknown")


def broker_org(subdomain: Column) -> Column:
    """The organisation of a request; ``local`` for none."""
    return F.coalesce(F.nullif(subdomain, F.lit("")), F.lit("local"))


def click_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CLICK_KEYS).agg(F.count(F.lit(1)).alias("click_count")).withColumn("aggregation_key", aggregation_key(*map(F.col, CLICK_KEYS)))


def merge_counts(held: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Counters added up by key: an upsert as one aggregation of both, which keeps map-side sums."""
    return held.select(*keys, *counts).unionByName(new.select(*keys, *counts)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
