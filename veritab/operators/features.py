"""Per-cell features: one row per (record, column), from the data alone and never from labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.numbers import nan_as_missing, outside_range, safe_ratio
from veritab.functions.text import (
    differs_by_case_only,
    edit_distance_to,
    has_case_mismatch,
    has_edge_space,
)
from veritab.operators.complete import complete_pairs
from veritab.operators.copies import copy_counts
from veritab.operators.keyed import keyed_pairs
from veritab.operators.labels import INDEXED, label_distances
from veritab.operators.nearest import nearest_earlier, nearest_pairs
from veritab.operators.profile import ColumnStats, cell_key, column_stats, value_counts
from veritab.operators.skew import heavy_lookup
from veritab.session import materialize
from veritab.spec import CLEAN, TableSpec

COLUMN_FEATURES = [
    "is_null", "value_freq", "value", "robust_z", "ratio_to_median", "dist_outside_range",
    "in_allowed_set", "edit_dist_to_allowed", "has_whitespace", "case_mismatch",
]
ROW_FEATURES = ["n_exact_copies", "n_earlier_copies", "nearest_earlier_dist"]


def feature_names(spec: TableSpec) -> list[str]:
    return COLUMN_FEATURES + ROW_FEATURES + [f"col_{c}" for c in spec.features]


#: The nearest earlier record over all columns, by keys and a tree or by the tree alone; or among those
#: that differ in one column at most, where a distance that isn't known stays NULL.
SEARCHES = {"complete": complete_pairs, "exact": nearest_pairs, "keyed": keyed_pairs}


def row_features(df: DataFrame, spec: TableSpec, search: str = "complete") -> DataFrame:
    """id with the three row features; copies here ignore the target."""
    copies = copy_counts(df, spec.features, spec.id_col)
    nearest = nearest_earlier(materialize(SEARCHES[search](df, spec)), spec.id_col, search != "keyed")
    zero = F.lit(0).cast("bigint")
    return nearest.join(copies, spec.id_col, "left").select(
        spec.id_col,
        F.coalesce("n_exact_copies", zero).alias("n_exact_copies"),
        F.coalesce("n_earlier_copies", zero).alias("n_earlier_copies"),
        "nearest_earlier_dist",
    )


def _number_features(name: str, spec: TableSpec, stats: ColumnStats, x: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    known = stats.median is not None
    centre = F.lit(stats.median if known else 0.0)
    span = spec.ranges.get(name)
    return {
        "value": F.coalesce(x, zero),
        "robust_z": F.coalesce((x - centre) / F.lit(stats.spread), zero) if known else zero,
        "ratio_to_median": F.coalesce(safe_ratio(x, centre), zero) if known else zero,
        "dist_outside_range": outside_range(x, *span) if span else zero,
        "in_allowed_set": F.lit(1),
        "has_whitespace": F.lit(0),
        "case_mismatch": F.lit(0),
    }


def _category_features(name: str, spec: TableSpec, lowercase_labels: bool, text: Column) -> dict[str, Column]:
    allowed = spec.allowed.get(name, ())
    valid = text.isin(*allowed) if allowed else F.lit(True)
    wrong_case = has_case_mismatch(text) if lowercase_labels else differs_by_case_only(text, allowed)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    zero = F.lit(0.0)
    return {
        "value": zero,
        "robust_z": zero,
        "ratio_to_median": zero,
        "dist_outside_range": zero,
        "in_allowed_set": flag(valid & text.isNotNull()),
        "has_whitespace": flag(has_edge_space(text)),
        "case_mismatch": flag(wrong_case),
    }


def uses_lowercase_labels(spec: TableSpec) -> bool:
    return all(label == label.lower() for label in spec.all_labels)


def value_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Per distinct value: how frequent it is, and how far from the nearest allowed label.

    The edit distance is computed once per value here, not once per cell, and for columns with many labels
    through an index.
    """
    counts = value_counts(df, spec)
    distance = F.lit(0)
    many = {c: allowed for c, allowed in spec.allowed.items() if len(allowed) >= INDEXED}
    for c, allowed in spec.allowed.items():
        if c not in many:
            distance = F.when(F.col("column") == c, edit_distance_to(F.col("key"), allowed)).otherwise(distance)
    if not many:
        return counts.withColumn("edit_dist_to_allowed", distance)
    counts = materialize(counts)
    indexed = label_distances(counts.filter(F.col("column").isin(*many)), many)
    found = F.coalesce("edit_distance", distance)
    return counts.join(indexed, ["column", "key"], "left").withColumn("edit_dist_to_allowed", found).drop("edit_distance")


def column_features(df: DataFrame, spec: TableSpec, carry: Sequence[str] = (), labels: str | None = None) -> DataFrame:
    """Long table (id, column, ten column features), plus the columns of ``df`` to carry along.

    Cells cross the exchange of the value lookup as (id, column, value) only; all features follow
    from these and are computed behind it. With ``labels``, the prefix of the columns of ``df`` that
    hold each cell's label, the result has a ``label`` as well.
    """
    df = nan_as_missing(df, spec.numbers)
    stats = column_stats(df, spec.numbers)
    lowercase = uses_lowercase_labels(spec)
    blocks = []
    for c in spec.features:
        number = F.lit(None) if c in spec.categories else F.col(c)
        block = [F.lit(c).alias("column"), cell_key(c, spec).alias("key"), number.cast("double").alias("_x")]
        if labels is not None:
            block.append(F.col(f"{labels}{c}").alias("label"))
        blocks.append(F.struct(*block))
    cells = df.select(spec.id_col, *carry, F.explode(F.array(*blocks)).alias("cell")).select(
        spec.id_col, *carry, "cell.*"
    )
    found = heavy_lookup(cells, value_table(df, spec), ["column", "key"], "n", spec.id_col)
    x, text = F.col("_x"), F.col("key")
    per_column = {
        c: _category_features(c, spec, lowercase, text) if c in spec.categories else _number_features(c, spec, stats[c], x)
        for c in spec.features
    }

    def chosen(feature: str) -> Column:
        out = None
        for c, features in per_column.items():
            here = F.col("column") == c
            out = F.when(here, features[feature]) if out is None else out.when(here, features[feature])
        return out.alias(feature)

    return found.select(
        spec.id_col,
        "column",
        text.isNull().cast("int").alias("is_null"),
        F.coalesce("value_freq", F.lit(0.0)).alias("value_freq"),
        *map(chosen, COLUMN_FEATURES[2:7]),
        F.coalesce("edit_dist_to_allowed", F.lit(0)).alias("edit_dist_to_allowed"),
        *map(chosen, COLUMN_FEATURES[8:]),
        *carry,
        *([F.when(F.col("label") == "", CLEAN).otherwise(F.coalesce("label", F.lit(CLEAN))).alias("label")] if labels is not None else []),
    )


def build_cell_features(df: DataFrame, spec: TableSpec, search: str = "complete", mask: DataFrame | None = None) -> DataFrame:
    """Long table with the keys (id, column) and every feature of :func:`feature_names`.

    Row features join once per record, before the record is spread over its cells, and so does the
    wide ``mask`` of true labels if one is given; the result then has a ``label``. What is joined is written
    once: the column profiles scan it again and again.
    """
    wide, labels = df.join(row_features(df, spec, search), spec.id_col), None
    if mask is not None:
        labels = "_label_"
        wide = wide.join(mask.select(spec.id_col, *[F.col(c).alias(f"{labels}{c}") for c in spec.features]), spec.id_col, "left")
    cells = column_features(materialize(wide), spec, ROW_FEATURES, labels)
    return cells.select(
        "*", *[(F.col("column") == c).cast("int").alias(f"col_{c}") for c in spec.features]
    )


def cell_labels(cells: DataFrame, cell_truth: DataFrame, spec: TableSpec) -> DataFrame:
    """Add each cell's true label, ``clean`` where the answer key has none."""
    return cells.join(cell_truth, [spec.id_col, "column"], "left").withColumn(
        "label", F.coalesce("label", F.lit(CLEAN))
    )
