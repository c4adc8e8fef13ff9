"""Column profiles: robust statistics, value counts and summary tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.numbers import nan_as_missing, no_nan
from veritab.operators.quantiles import quantile_frame, quantiles
from veritab.spec import TableSpec

# Fixed value: makes the median absolute deviation comparable to a standard deviation.
MAD_TO_STD = 1.4826


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of one number column. All are plain numbers, used as literals afterwards."""

    median: float | None
    mad: float | None
    std: float | None

    @property
    def spread(self) -> float:
        """What a robust z-score divides by."""
        if self.mad:
            return MAD_TO_STD * self.mad
        return self.std or 1.0


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Median, median absolute deviation and sample deviation of each column, all exact."""
    df = nan_as_missing(df, columns)
    values = {c: F.col(c).cast("double") for c in columns}
    if not values:
        return {}
    stds = df.agg(F.struct(*[F.stddev_samp(v).alias(c) for c, v in values.items()])).first()[0]
    medians = {c: q[0] for c, q in quantiles(df, values, [0.5]).items()}
    gaps = {c: F.abs(v - F.lit(medians[c])) for c, v in values.items() if medians[c] is not None}
    mads = quantiles(df, gaps, [0.5])
    return {c: ColumnStats(medians[c], mads.get(c, [None])[0], stds[c]) for c in columns}


@dataclass(frozen=True)
class Scale:
    """How a number column is imputed and scaled for distances."""

    median: float
    width: float

    def apply(self, value: Column) -> Column:
        filled = F.coalesce(no_nan(value.cast("double")), F.lit(self.median))
        return (filled - F.lit(self.median)) / F.lit(self.width)


def distance_scales(
    df: DataFrame, columns: Sequence[str], flat_as_std: bool = True
) -> dict[str, Scale]:
    """Median and interquartile range per column, the range taken after imputing the median.

    A column whose range is 0 is divided by its sample deviation, or left as it is with
    ``flat_as_std=False``; a constant column is never divided.
    """
    df = nan_as_missing(df, columns)
    raw = {c: F.col(c).cast("double") for c in columns}
    medians = {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(df, raw, [0.5]).items()}
    filled = {c: F.coalesce(v, F.lit(medians[c])) for c, v in raw.items()}
    if not filled:
        return {}
    stds = df.agg(F.struct(*[F.stddev_samp(v).alias(c) for c, v in filled.items()])).first()[0]
    quartiles = quantiles(df, filled, [0.25, 0.75])
    scales = {}
    for c in columns:
        low, high = quartiles[c]
        iqr = 0.0 if low is None else high - low
        fallback = (stds[c] or 1.0) if flat_as_std else 1.0
        scales[c] = Scale(medians[c], iqr if iqr > 0 else fallback)
    return scales


def cell_key(name: str, spec: TableSpec) -> Column:
    """A cell's value as text, the same text for equal values; NULL if missing."""
    # Adding 0 turns -0.0 into 0.0.
    return F.col(name) if name in spec.categories else (F.col(name).cast("double") + 0.0).cast("string")


def value_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, key, n, value_freq): each value's share of the non-missing values of its column."""
    df = nan_as_missing(df, spec.numbers)
    sizes = df.agg(*[F.count(c).alias(c) for c in spec.features]).first()
    cells = F.explode(
        F.array(*[
            F.struct(
                F.lit(c).alias("column"),
                cell_key(c, spec).alias("key"),
                F.lit(sizes[c]).cast("double").alias("present"),
            )
            for c in spec.features
        ])
    )
    return (
        df.select(cells.alias("cell"))
        .select("cell.*")
        .filter("key is not null")
        .groupBy("column", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.first("present").alias("present"))
        .select("column", "key", "n", (F.col("n") / F.col("present")).alias("value_freq"))
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each text column, the smallest one on ties."""
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("key")) for c in columns])
        ).alias("cell")
    ).select("cell.*")
    counts = cells.filter("key is not null").groupBy("column", "key").count()
    rows = (
        counts.groupBy("column")
        .agg(F.min_by("key", F.struct(-F.col("count"), F.col("key"))).alias("key"))
        .collect()
    )
    found = {r["column"]: r["key"] for r in rows}
    return {c: found.get(c) for c in columns}


def summary(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, rounded; one row per column."""
    df = nan_as_missing(df, columns)
    values = {c: F.col(c).cast("double") for c in columns}
    moments = df.agg(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"c{i}")
            for i, (c, v) in enumerate(values.items())
        ]
    )
    tall = moments.select(
        F.explode(F.array(*[F.col(f"c{i}") for i in range(len(values))])).alias("m")
    ).select("m.*")
    quartiles = (
        quantile_frame(df, values, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ])
    )
    rounded = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return (
        tall.join(F.broadcast(quartiles), "column", "left")
        .orderBy("position")
        .select("column", "count", *[F.bround(c, digits).alias(c) for c in rounded])
    )
