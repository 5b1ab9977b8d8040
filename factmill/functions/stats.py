"""Intervals, ratios and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, total: Column) -> Column:
    """lower and upper of the 95 % score interval; zeros where nothing was counted."""
    p = successes / total
    base = 1 + Z * Z / total
    middle = (p + Z * Z / (2 * total)) / base
    spread = Z * F.sqrt(p * (1 - p) / total + Z * Z / (4 * total * total)) / base
    none = total <= 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - spread)).alias("lower"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), middle + spread)).alias("upper"))


def ratio(successes: Column, total: Column) -> Column:
    return F.when(total > 0, successes / total)


def round_usd(c: Column) -> Column:
    return F.round(c, 12)


def component_cost(units: Column, rate: Column, per: int) -> Column:
    return round_usd(units * rate / per)


def optional_cost(units: Column, rate: Column, per: int) -> Column:
    return F.when(units.isNull() | (units == 0), 0.0).otherwise(component_cost(units, rate, per))


def strict_sum(c: Column) -> Column:
    """The sum, or null if any value is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def response_cost(usage: dict[str, Column], rates: dict[str, Column]) -> dict[str, Column]:
    """usage: uncached, cached, cache_write, output, searches, present. rates: version, input, cached, cache_write,
    output, search. Five components and, where usage is present and all are known, their total."""
    write, fresh = usage["cache_write"], usage["uncached"]
    standard = F.when(fresh.isNotNull() & write.isNotNull(), F.when(write <= fresh, fresh - write)).otherwise(fresh)
    out = {
        "input_usd": component_cost(standard, rates["input"], 1_000_000),
        "cached_input_usd": component_cost(usage["cached"], rates["cached"], 1_000_000),
        "output_usd": component_cost(usage["output"], rates["output"], 1_000_000),
        "cache_write_usd": optional_cost(write, rates["cache_write"], 1_000_000),
        "web_search_usd": component_cost(usage["searches"], rates["search"], 1_000),
    }
    total = sum(out.values(), F.lit(0.0))
    estimated = F.coalesce(usage["present"] & rates["version"].isNotNull() & (rates["version"] != "") & total.isNotNull(), F.lit(False))
    return out | {"estimated": estimated, "total_usd": F.when(estimated, round_usd(total))}
