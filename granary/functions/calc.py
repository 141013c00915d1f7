"""Deterministic calculations; each gives a value, or null with an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _outcome(ok: Column, value: Column, error: str, name: str = "value") -> Column:
    return F.struct(F.when(ok, F.round(value, 4)).alias(name), F.when(~F.coalesce(ok, F.lit(False)), F.lit(error)).alias("error"))


def growth_rate(before: Column, after: Column) -> Column:
    """Change in percent of the size of ``before``."""
    return _outcome((before != 0) & after.isNotNull(), (after - before) / F.nullif(F.abs(before), F.lit(0)) * 100, "before is zero or missing")


def ratio(numerator: Column, denominator: Column) -> Column:
    ok = (denominator != 0) & numerator.isNotNull()
    value = numerator / F.nullif(denominator, F.lit(0))
    return F.struct(F.when(ok, F.round(value, 4)).alias("ratio"), F.when(ok, F.round(value * 100, 4)).alias("percent"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("denominator is zero or missing")).alias("error"))


def cagr(begin: Column, end: Column, years: Column) -> Column:
    """Compound yearly growth in percent."""
    ok = (begin > 0) & (years > 0) & end.isNotNull()
    value = (F.pow(end / F.when(begin > 0, begin), F.lit(1.0) / F.when(years > 0, years)) - 1) * 100
    return _outcome(ok & ~F.isnan(value), value, "no growth rate exists")
