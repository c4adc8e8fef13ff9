"""From a raw table to a clean baseline: complete rows, whole numbers, labels, ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from veritab.operators.rank import ordered_index
from veritab.spec import TableSpec


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns or df.columns))


def whole_number(value: Column) -> Column:
    """Truncate to a whole number; text that is no number becomes missing.

    Decimals come first: they hold every BIGINT exactly, which doubles do not.
    """
    exact = value.try_cast("decimal(38,18)").try_cast("bigint")
    return F.coalesce(exact, value.try_cast("double").try_cast("bigint"))


def to_whole_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: whole_number(F.col(c)) for c in columns})


def decode(code: Column, labels: Mapping[int, str]) -> Column:
    """Label of a category code; an unknown code becomes missing."""
    pairs = chain.from_iterable((F.lit(k).cast("bigint"), F.lit(v)) for k, v in labels.items())
    return F.try_element_at(F.create_map(*pairs), whole_number(code))


def decode_categories(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumns({c: decode(F.col(c), labels) for c, labels in spec.decode.items()})


def assign_record_id(df: DataFrame, name: str, order_by: Sequence = ()) -> DataFrame:
    """Give every row the id 0..n-1 in the given order, then in scan order."""
    numbered, _ = ordered_index(df, order_by, name)
    return numbered.select(name, *df.columns)


def load_clean(raw: DataFrame, spec: TableSpec, whole: Sequence[str] = (), order_by: Sequence = ()) -> DataFrame:
    """Complete rows only, codes decoded, and a record id where the table has none."""
    df = complete_rows(raw, spec.record_columns)
    df = decode_categories(to_whole_numbers(df, whole), spec)
    if spec.id_col not in df.columns:
        df = assign_record_id(df, spec.id_col, order_by)
    return spec.validate(df.select(spec.id_col, *spec.record_columns))
