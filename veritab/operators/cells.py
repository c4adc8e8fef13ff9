"""Between wide tables (one row per record) and long cells (one row per record and column).

Masks are kept long and sparse: only cells that carry a label. A clean cell is an absent row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from veritab.spec import CLEAN, TableSpec


def labelled_cells(mask: DataFrame, spec: TableSpec) -> DataFrame:
    """Wide mask ('' or NULL = clean) to long (id, column, label)."""
    cell = F.explode(
        F.filter(
            F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in spec.features
            ]),
            lambda x: x["label"] != "",
        )
    )
    return mask.select(spec.id_col, cell.alias("cell")).select(spec.id_col, "cell.*")


def wide_mask(cells: DataFrame, ids: DataFrame, spec: TableSpec) -> DataFrame:
    """Long (id, column, label) to one row per id of ``ids``, '' where a cell is clean."""
    wide = cells.groupBy(spec.id_col).agg(
        *[F.max(F.when(F.col("column") == c, F.col("label"))).alias(c) for c in spec.features]
    )
    return (
        ids.select(spec.id_col)
        .join(wide, spec.id_col, "left")
        .select(
            spec.id_col,
            *[
                F.when(F.col(c) == CLEAN, "").otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c)
                for c in spec.features
            ],
        )
    )


def all_cells(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, column) of every cell."""
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(id_col, F.explode(names).alias("column"))
