"""Rule checks that give each cell one label.

Priority, highest first: missing, out of range, unknown category, exact duplicate. All but the
last look at one cell and are a projection; they take a streaming table as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.operators.cells import labelled_cells
from veritab.operators.copies import later_copies
from veritab.operators.skew import sparse_lookup
from veritab.spec import TableSpec

_LATER = "_later_copy"


def is_unknown_category(df: DataFrame, spec: TableSpec, column: str) -> Column:
    value = df[column]
    return F.coalesce(~value.isin(*spec.allowed[column]), F.lit(False))


def is_out_of_range(df: DataFrame, spec: TableSpec, column: str) -> Column:
    low, high = spec.ranges[column]
    return F.coalesce(~df[column].between(float(low), float(high)) & ~F.isnan(df[column]), F.lit(False))


def is_missing(df: DataFrame, spec: TableSpec, column: str) -> Column:
    """NULL, or NaN in a number column."""
    return df[column].isNull() | F.isnan(df[column]) if column in spec.numbers else df[column].isNull()


def cell_label(df: DataFrame, spec: TableSpec, column: str) -> Column:
    """The label of one cell from the checks that need nothing but the cell."""
    label = F.when(is_missing(df, spec, column), "missing")
    if column in spec.ranges:
        label = label.when(is_out_of_range(df, spec, column), "out_of_range")
    if column in spec.allowed:
        label = label.when(is_unknown_category(df, spec, column), "category_typo")
    return label


def cell_rule_mask(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Wide mask of the cell checks alone; no exchange, also on a stream."""
    return df.select(
        spec.id_col, *[F.coalesce(cell_label(df, spec, c), F.lit("")).alias(c) for c in spec.features]
    )


def apply_rules(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Wide mask of all rules: '' where a cell looks fine, else the label of the rule."""
    copies = later_copies(df, spec.record_columns, spec.id_col)
    marked = sparse_lookup(df, copies.select(spec.id_col, F.lit(True).alias(_LATER)), spec.id_col)
    return marked.select(
        spec.id_col,
        *[
            F.coalesce(
                cell_label(marked, spec, c),
                F.when(F.col(_LATER), F.lit("exact_duplicate")),
                F.lit(""),
            ).alias(c)
            for c in spec.features
        ],
    )


def rule_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The same findings as long (id, column, label) rows."""
    return labelled_cells(apply_rules(df, spec), spec)
