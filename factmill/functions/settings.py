"""Texts of settings as values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ["1", "true", "yes", "on"]
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def boolean_value(c: Column, default: bool = False) -> Column:
    """Whether a text is one of TRUE_WORDS; the default for null and empty texts."""
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(F.lower(c).isin(*TRUE_WORDS))


def _number(c: Column) -> Column:
    """A finite decimal number; null for other texts. Blank counts as zero."""
    t = F.trim(c)
    n = F.when(t == "", 0.0).when(t.rlike(DECIMAL), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def number_value(c: Column, default: float) -> Column:
    """A positive number, else the default."""
    n = _number(c)
    return F.when(n > 0, n).otherwise(F.lit(float(default)))


def bounded_number_value(c: Column, default: float, most: float) -> Column:
    return F.least(number_value(c, default), F.lit(float(most)))


def optional_number_value(c: Column) -> Column:
    """A number of zero or more; null for other and blank texts."""
    n = _number(F.nullif(F.trim(c), F.lit("")))
    return F.when(n >= 0, n)
