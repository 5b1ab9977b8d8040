"""Usage of a model: cost per attempt, summary per search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.stats import response_cost, round_usd, strict_sum

TOKENS = ["inputTokens", "cachedInputTokens", "uncachedInputTokens", "cacheWriteTokens", "outputTokens", "reasoningOutputTokens", "totalTokens"]
RATES = ("version", "input", "cached", "cache_write", "output", "search")


def with_costs(attempts: DataFrame, rates: dict[str, object]) -> DataFrame:
    """attempts: columns of coerce.usage (flat). Adds the five cost components, estimated and total_usd."""
    c = F.col
    used = {"uncached": c("uncachedInputTokens"), "cached": c("cachedInputTokens"), "cache_write": c("cacheWriteTokens"), "output": c("outputTokens"), "searches": c("webSearchCalls"), "present": c("usagePresent")}
    prices = {k: F.lit(rates.get(k)).cast("string" if k == "version" else "double") for k in RATES}
    return attempts.withColumns(response_cost(used, prices))


def duration_ms(c):
    """A duration in whole milliseconds, halves up, not below zero."""
    return F.greatest(F.lit(0), F.floor(c + 0.5)).cast("long")


def usage_records(attempts: DataFrame, rates: dict[str, object]) -> DataFrame:
    """attempts: columns of coerce.usage (flat) and duration. Records with costs and duration_ms."""
    return with_costs(attempts, rates).withColumn("duration_ms", duration_ms(F.col("duration")))


def summary_columns(attempts: DataFrame) -> list[Column]:
    """What is known of the attempts of one search."""
    n = F.count(F.lit(1))
    return [
        F.min_by("model", "attempt_ordinal").alias("model"), n.alias("attempts"), (n - 1).alias("retries"), F.count_if(~F.coalesce("usagePresent", F.lit(False))).alias("missing_usage"),
        *(strict_sum(F.col(t)).alias(t) for t in TOKENS if t in attempts.columns), round_usd(strict_sum(F.col("total_usd"))).alias("total_usd"),
    ]


def search_summary(attempts: DataFrame, key: str) -> DataFrame:
    """attempts: key, attempt_ordinal, model, usagePresent, TOKENS, total_usd. Per search: attempts, retries, attempts
    without usage, sums that are null where any part is, and the model of the first attempt."""
    return attempts.groupBy(key).agg(*summary_columns(attempts))


def search_costs(attempts: DataFrame, key: str, version: str | None) -> DataFrame:
    """attempts: key, attempt_ordinal, attempt (initial or identity_retry), total_usd, webSearchCalls. Per search whether
    its cost is known, the version of the prices (null where it isn't), identity retries and calls."""
    known = F.count("total_usd") == F.count(F.lit(1))
    return attempts.groupBy(key).agg(known.alias("estimated"), F.when(known, F.lit(version)).alias("pricing_version"), F.count_if(F.col("attempt") == "identity_retry").alias("identity_retries"), F.sum("webSearchCalls").alias("web_search_calls"))


def request_metadata(requests: DataFrame) -> DataFrame:
    """How many requests name an NPI, an id, a place."""
    some = lambda *cols: F.count_if(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols)).isNotNull())
    return requests.agg(F.count(F.lit(1)).alias("providers"), some("npi").alias("with_npi"), some("providerId").alias("with_provider_id"), some("city", "state", "zip").alias("with_location"))
