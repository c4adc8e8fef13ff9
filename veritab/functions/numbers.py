"""Number expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veritab.spec import UnitChange


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Division that reads a zero denominator as 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def convert_unit(value: str, change: UnitChange) -> str:
    """Expression text of ``value`` recorded in the wrong unit."""
    moved = f"{value} {'/' if change.divide else '*'} {float(change.factor)!r}D"
    return f"({moved})" if change.digits is None else f"bround({moved}, {change.digits})"


def outside_range(value: Column, low: float, high: float) -> Column:
    """How far a value lies outside [low, high], as a share of the range; 0 if missing."""
    gap = F.greatest(F.lit(float(low)) - value, F.lit(0.0)) + F.greatest(
        value - F.lit(float(high)), F.lit(0.0)
    )
    return F.when(value.isNull(), F.lit(0.0)).otherwise(gap / F.lit(float(high - low)))


def no_nan(value: Column) -> Column:
    """NaN is not a second kind of missing value: turn it into NULL."""
    return F.when(~F.isnan(value), value)


def nan_as_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with NaN turned into NULL in those number columns that can hold it."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    found = [c for c in columns if c in floating]
    return df.withColumns({c: no_nan(F.col(c)) for c in found}) if found else df
