"""Labelled errors planted in a clean table, as one projection.

Each picked cell or row is one whose md5 draw lies at or below an exact cutoff
(:mod:`veritab.operators.pick`). Once the few cutoffs are known, the corrupted values and their
labels are expressions over the row itself: no join, no shuffle, and a lost task repeats exactly
the same errors. Only the copies added at the end are numbered, with a bucketed rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from veritab.functions.hashing import column, draw, draw_fraction, draw_index, draw_item, text
from veritab.functions.numbers import convert_unit, nan_as_missing
from veritab.functions.text import misspell
from veritab.operators.cells import labelled_cells
from veritab.operators.pick import digest_cutoffs
from veritab.operators.rank import digest_rank
from veritab.session import materialize, spread_evenly
from veritab.spec import CELL_ERROR_TYPES, ERROR_TYPES, TableSpec


@dataclass(frozen=True)
class Injected:
    """A corrupted table with its answer key."""

    spec: TableSpec
    table: DataFrame
    mask: DataFrame
    row_truth: DataFrame

    @property
    def cell_truth(self) -> DataFrame:
        """Long (id, column, label), labelled cells only."""
        return labelled_cells(self.mask, self.spec)


def error_budget(rows: int, rate: float) -> int:
    """Errors per type: the rate's share of the rows, rounded half-even, at least one."""
    return max(1, round(rate * rows))


def stage_columns(spec: TableSpec) -> dict[str, list[str]]:
    """The columns each cell error type may strike, in the order the types are planted."""
    return {
        "missing": spec.features,
        "out_of_range": list(spec.bad_values),
        "category_typo": spec.categories,
        "unit_inconsistency": list(spec.units),
    }


def _cell_draw(spec: TableSpec, seed: int, stage: str, name: str) -> str:
    return draw(seed, stage, column(spec.id_col), text(name))


def _row_draw(spec: TableSpec, seed: int, stage: str) -> str:
    return draw(seed, stage, column(spec.id_col))


def _picked_label(spec: TableSpec, seed: int, cutoffs: Mapping[str, str], name: str) -> str:
    """Label of a base cell given the cutoffs known so far; NULL while it is clean."""
    columns = stage_columns(spec)
    hits = [
        f"WHEN {_cell_draw(spec, seed, stage, name)} <= '{cutoffs[stage]}' THEN '{stage}'"
        for stage in CELL_ERROR_TYPES
        if stage in cutoffs and name in columns[stage]
    ]
    return f"CASE WHEN {column(name)} IS NULL THEN NULL {' '.join(hits)} END" if hits else "CAST(NULL AS STRING)"


#: How many times the wanted share of draws passes a first cut, since some candidates are taken already; widened
#: if that is too little.
_MARGIN = 1.5
#: Deviations above the wanted number of draws that a first cut leaves besides.
_SPARE = 10


def _first_cut(wanted: int, candidates: int, margin: float) -> str:
    """A draw below which about ``margin`` times the wanted number of candidates lies, and some more in small tables."""
    share = margin * (wanted + _SPARE * math.sqrt(wanted) + _SPARE) / max(candidates, 1)
    return "g" if share >= 1 else format(int(share * 16**12), "012x")


def low_draws(df: DataFrame, spec: TableSpec, seed: int, n_errors: int, margin: float) -> tuple[DataFrame, bool]:
    """One row per cell with a low draw in any stage: the draw of each stage, NULL above its cut.

    The flag tells whether nothing was cut off.
    """
    stages = {stage: columns for stage, columns in stage_columns(spec).items() if columns}
    present = df.agg(*[F.count(c).alias(c) for c in spec.features]).first()
    cuts = {s: _first_cut(n_errors, sum(present[c] for c in columns), margin) for s, columns in stages.items()}
    cells = []
    for c in spec.features:
        draws = []
        for stage, columns in stages.items():
            value = _cell_draw(spec, seed, stage, c)
            low = f"CASE WHEN {column(c)} IS NOT NULL AND {value} < '{cuts[stage]}' THEN {value} END"
            draws.append(f"{text(stage)}, {low if c in columns else 'CAST(NULL AS STRING)'}")
        cells.append(f"named_struct({', '.join(draws)})")
    exploded = df.selectExpr(f"explode(array({', '.join(cells)})) AS cell").select("cell.*")
    some = " OR ".join(f"{stage} IS NOT NULL" for stage in stages)
    # Draws are written as 16 bytes, not as 32 digits.
    packed = materialize(exploded.filter(some).selectExpr(*[f"unhex({stage}) AS {stage}" for stage in stages]))
    return packed.selectExpr(*[f"lower(hex({stage})) AS {stage}" for stage in stages]), all(cut == "g" for cut in cuts.values())


def pick_cells(df: DataFrame, spec: TableSpec, seed: int, n_errors: int) -> dict[str, str]:
    """The cutoff of each cell error type; later types only see cells left clean by earlier ones.

    One scan keeps the low draws of all stages; the cutoffs are found on that small table. Should it
    hold too few free cells for a stage, it is drawn anew with a wider cut.
    """
    margin = _MARGIN
    while True:
        cells, whole = low_draws(df, spec, seed, n_errors, margin)
        cutoffs: dict[str, str] = {}
        try:
            for stage, columns in stage_columns(spec).items():
                if columns:
                    free = cells.filter(F.col(stage).isNotNull())
                    for earlier, cutoff in cutoffs.items():
                        free = free.filter(F.col(earlier).isNull() | (F.col(earlier) > cutoff))
                    cutoffs[stage] = digest_cutoffs(free, F.col(stage), [n_errors])[0]
            return cutoffs
        except ValueError:
            if whole:
                raise
            margin *= 4


def pick_rows(drawn: DataFrame, clean: str, size: int, n_errors: int, changeable: str) -> tuple[str, str, DataFrame]:
    """Cutoffs of the exact and the near copies among the ``clean`` rows with a ``_digest``, and these rows.

    One scan keeps the rows with low draws, whole; whether a row is clean is only asked of these.
    """
    margin = _MARGIN
    while True:
        cut = _first_cut(2 * n_errors, size, margin)
        low = materialize(drawn.filter(F.col("_digest") < cut).filter(clean))
        try:
            exact_end = digest_cutoffs(low, F.col("_digest"), [n_errors])[0]
            # Near copies come from the rows behind, as far as these hold a value that can change.
            behind = low.filter((F.col("_digest") > exact_end) & F.expr(changeable))
            near_end = digest_cutoffs(behind, F.col("_digest"), [n_errors])[0]
        except ValueError:
            if cut == "g":
                raise
            margin *= 4
            continue
        picked = (F.col("_digest") <= exact_end) | ((F.col("_digest") <= near_end) & F.expr(changeable))
        return exact_end, near_end, low.filter(picked)


def _is_clean(spec: TableSpec, seed: int, cutoffs: Mapping[str, str]) -> str:
    return " AND ".join(f"{_picked_label(spec, seed, cutoffs, c)} IS NULL" for c in spec.features)


def clean_rows(df: DataFrame, spec: TableSpec, seed: int, cutoffs: Mapping[str, str]) -> DataFrame:
    """The rows none of whose cells were picked."""
    return df.filter(_is_clean(spec, seed, cutoffs))


def _typo(spec: TableSpec, seed: int, stage: str, name: str) -> str:
    return misspell(column(name), spec.all_labels, _cell_draw(spec, seed, f"{stage}_text", name))


def _corrupted(spec: TableSpec, seed: int, name: str) -> str:
    """The value a base cell holds after planting the error its label names."""
    planted = ["WHEN 'missing' THEN NULL"]
    if name in spec.bad_values:
        bad = draw_item(_cell_draw(spec, seed, "bad_value", name), spec.bad_values[name])
        planted.append(f"WHEN 'out_of_range' THEN {bad}")
    if name in spec.categories:
        planted.append(f"WHEN 'category_typo' THEN {_typo(spec, seed, 'category_typo', name)}")
    if name in spec.units:
        planted.append(f"WHEN 'unit_inconsistency' THEN {convert_unit(column(name), spec.units[name])}")
    return f"CASE {_mask(name)} {' '.join(planted)} ELSE {column(name)} END AS {column(name)}"


def _filled(columns: Sequence[str]) -> str:
    """The names among ``columns`` that hold a value in this row, as an array."""
    return f"array_compact(array({', '.join(f'CASE WHEN {column(c)} IS NOT NULL THEN {text(c)} END' for c in columns)}))"


def _changeable(spec: TableSpec) -> str:
    """Whether a row holds anything that a near copy could change."""
    return f"size({_filled([*spec.nudge, *spec.categories])}) > 0"


def _near_copy(spec: TableSpec, seed: int, near: str) -> dict[str, str]:
    """One small change to a copied row: a measurement moved by one, or one misspelling.

    The column is drawn among those of its kind that hold a value; a row that holds values of one
    kind only gets that kind.
    """
    nudged, spelled = list(spec.nudge), spec.categories
    some = {kind: _filled(columns) if columns else "CAST(array() AS ARRAY<STRING>)" for kind, columns in (("n", nudged), ("s", spelled))}
    coin = (
        f"CASE WHEN size({some['n']}) = 0 THEN FALSE WHEN size({some['s']}) = 0 THEN TRUE "
        f"ELSE {draw_fraction(_row_draw(spec, seed, 'near_kind'))} < 0.5D END"
    )
    place = _row_draw(spec, seed, "near_column")
    sign = f"CASE WHEN {draw_fraction(_row_draw(spec, seed, 'near_sign'))} < 0.5D THEN -1D ELSE 1D END"

    def drawn(kind: str) -> str:
        index = draw_index(place, f"greatest(size({some[kind]}), 1)")
        return f"try_element_at({some[kind]}, CAST({index} + 1 AS INT))"

    changed = {}
    for c in nudged:
        hit = f"{near} AND ({coin}) AND {drawn('n')} = {text(c)}"
        changed[c] = f"CASE WHEN {hit} THEN {column(c)} + {sign} ELSE {column(c)} END"
    for c in spelled:
        hit = f"{near} AND NOT ({coin}) AND {drawn('s')} = {text(c)}"
        changed[c] = f"CASE WHEN {hit} THEN {_typo(spec, seed, 'near_typo', c)} ELSE {column(c)} END"
    return changed


def _mask(name: str) -> str:
    return column(f"_label_{name}")


def inject_errors(df: DataFrame, spec: TableSpec, rate: float = 0.05, seed: int = 42, checked: bool = False) -> Injected:
    """Plant ``rate`` x rows errors of each of six types in ``df``.

    Copies get new, later ids, and carry their duplicate label in every cell. Numbers become
    DOUBLE, so that a missing or converted value fits. The outcome is written once, so the
    detectors that scan it again and again do not repeat the draws. ``checked`` tells that the ids of
    ``df`` were looked at before.
    """
    spec.validate(df)
    if not checked:
        spec.check_ids(df)
    if not spec.nudge and not spec.categories:
        raise ValueError(f"{spec.name}: a near copy needs a column to nudge or a category to misspell")
    record_id = column(spec.id_col)
    base = nan_as_missing(df, spec.numbers).selectExpr(
        f"CAST({record_id} AS BIGINT) AS {record_id}",
        *[
            f"CAST({column(c)} AS DOUBLE) AS {column(c)}" if c in spec.numbers else column(c)
            for c in spec.record_columns
        ],
    )
    base = spread_evenly(base, spec.id_col)
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.max(spec.id_col).alias("last_id")).first()
    n_errors = error_budget(size["rows"], rate)
    cutoffs = pick_cells(base, spec, seed, n_errors)
    others = [column(c) for c in spec.record_columns if c not in spec.features]

    labelled = base.selectExpr(
        "*", *[f"{_picked_label(spec, seed, cutoffs, c)} AS {_mask(c)}" for c in spec.features]
    )
    originals = labelled.selectExpr(
        record_id,
        *[_corrupted(spec, seed, c) for c in spec.features],
        *others,
        *[_mask(c) for c in spec.features],
        "CAST(NULL AS BIGINT) AS duplicate_of",
    )

    drawn = base.withColumn("_digest", F.expr(_row_draw(spec, seed, "duplicate")))
    exact_end, _, sources = pick_rows(drawn, _is_clean(spec, seed, cutoffs), size["rows"], n_errors, _changeable(spec))
    chosen = digest_rank(sources, "_digest", "_rank")
    near = f"_digest > '{exact_end}'"
    changed = _near_copy(spec, seed, near)
    label = f"CASE WHEN {near} THEN 'near_duplicate' ELSE 'exact_duplicate' END"
    copies = chosen.selectExpr(
        f"{size['last_id']} + _rank AS {record_id}",
        *[f"{changed.get(c, column(c))} AS {column(c)}" for c in spec.features],
        *others,
        *[f"{label} AS {_mask(c)}" for c in spec.features],
        f"{record_id} AS duplicate_of",
    )
    both = materialize(originals.unionByName(copies))
    found = f"array_compact(array({', '.join(_mask(c) for c in spec.features)}))"
    return Injected(
        spec=spec,
        table=both.select(spec.id_col, *spec.record_columns),
        mask=both.selectExpr(
            record_id, *[f"coalesce({_mask(c)}, '') AS {column(c)}" for c in spec.features]
        ),
        row_truth=both.selectExpr(
            record_id,
            f"size({found}) > 0 AS is_dirty",
            f"array_join(array_sort(array_distinct({found})), ';') AS error_types",
            "duplicate_of",
        ),
    )


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A seeded random order, for files whose row order a reader sees."""
    return df.orderBy(F.expr(draw(seed, "shuffle", column(id_col))))


def error_summary(cell_truth: DataFrame, spec: TableSpec) -> DataFrame:
    """(error_type, unit, count) of every type, also those that do not occur.

    Cell errors count cells; duplicates count rows that carry the label in all their cells.
    """
    per_row = cell_truth.groupBy(spec.id_col, "label").agg(F.count(F.lit(1)).alias("cells"))
    counts = per_row.groupBy("label").agg(
        F.sum("cells").alias("cells"), F.count_if(F.col("cells") == len(spec.features)).alias("rows")
    )
    units = [(i, e, "cells" if e in CELL_ERROR_TYPES else "rows") for i, e in enumerate(ERROR_TYPES)]
    types = cell_truth.sparkSession.createDataFrame(
        units, "position int, error_type string, unit string"
    )
    amount = F.when(F.col("unit") == "cells", F.col("cells")).otherwise(F.col("rows"))
    return (
        types.join(counts, types["error_type"] == counts["label"], "left")
        .select("position", "error_type", "unit", F.coalesce(amount, F.lit(0)).alias("count"))
        .orderBy("position")
        .drop("position")
    )
