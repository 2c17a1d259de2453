"""Null-, NaN- and zero-safe column arithmetic (valid under ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """True only for a present, non-NaN, bounded value; never null."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is zero or missing."""
    return F.when(F.abs(denominator) > 0, numerator / denominator)


def log_ratio(numerator: Column, denominator: Column) -> Column:
    """ln(numerator / denominator), null unless both sides are positive."""
    return F.when((numerator > 0) & (denominator > 0), F.ln(numerator / denominator))


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null in every floating-point column."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[finite_or_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def rounded(c: Column, digits: int) -> Column:
    """Round for reporting; a rounded zero is always positive zero."""
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
