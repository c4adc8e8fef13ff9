"""Declarative description of a table: column roles and what counts as valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

NUMERIC, CODED, CATEGORY = "numeric", "coded", "category"

# The labels every mask, truth table and score table uses, in report order.
CELL_ERROR_TYPES = ("missing", "out_of_range", "category_typo", "unit_inconsistency")
ROW_ERROR_TYPES = ("exact_duplicate", "near_duplicate")
ERROR_TYPES = CELL_ERROR_TYPES + ROW_ERROR_TYPES
CLEAN = "clean"


@dataclass(frozen=True)
class UnitChange:
    """A value recorded in the wrong unit: scaled by ``factor``, then rounded half-even."""

    factor: float
    divide: bool = False
    digits: int | None = None


@dataclass(frozen=True)
class TableSpec:
    """Roles and validity rules of one table.

    ``columns`` maps each feature column to its role, in display order. ``target`` is carried
    along and takes part in the exact-duplicate key, but is never corrupted or checked.
    """

    name: str
    id_col: str
    columns: Mapping[str, str]
    target: str | None = None
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    bad_values: Mapping[str, Sequence[float]] = field(default_factory=dict)
    units: Mapping[str, UnitChange] = field(default_factory=dict)
    nudge: Sequence[str] = ()
    decode: Mapping[str, Mapping[int, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.columns.values()) - {NUMERIC, CODED, CATEGORY}
        if unknown:
            raise ValueError(f"unknown column roles: {sorted(unknown)}")
        numbers, categories = set(self.numbers), set(self.categories)
        for part, names, known in (
            ("ranges", self.ranges, numbers),
            ("bad_values", self.bad_values, numbers),
            ("units", self.units, numbers),
            ("nudge", self.nudge, numbers),
            ("allowed", self.allowed, categories),
        ):
            stray = set(names) - known
            if stray:
                raise ValueError(f"{part} names columns of another role: {sorted(stray)}")

    def _with_role(self, *roles: str) -> list[str]:
        return [c for c, role in self.columns.items() if role in roles]

    @property
    def features(self) -> list[str]:
        return list(self.columns)

    @property
    def numbers(self) -> list[str]:
        """Every column that holds a number, measurements before codes."""
        return self._with_role(NUMERIC) + self._with_role(CODED)

    @property
    def categories(self) -> list[str]:
        return self._with_role(CATEGORY)

    @property
    def record_columns(self) -> list[str]:
        """The columns that make two records the same record."""
        return self.features + ([self.target] if self.target else [])

    @property
    def all_labels(self) -> list[str]:
        return sorted({label for labels in self.allowed.values() for label in labels})

    def validate(self, df: DataFrame) -> DataFrame:
        """Check that ``df`` has the columns and types the roles need; return it unchanged."""
        types = {f.name: f.dataType for f in df.schema}
        missing = [c for c in [self.id_col, *self.record_columns] if c not in types]
        if missing:
            raise ValueError(f"{self.name}: missing columns {missing}")
        if not isinstance(types[self.id_col], T.IntegralType):
            raise ValueError(f"{self.name}: {self.id_col} must be an integer id")
        for c in self.numbers:
            if not isinstance(types[c], T.NumericType):
                raise ValueError(f"{self.name}: {c} must be numeric, is {types[c].simpleString()}")
        for c in self.categories:
            if not isinstance(types[c], T.StringType):
                raise ValueError(f"{self.name}: {c} must be text, is {types[c].simpleString()}")
        return df

    def check_ids(self, df: DataFrame) -> DataFrame:
        """Check that every record has an id of its own; return ``df`` unchanged.

        Draws depend on the id alone, so records that share one would share all picks.
        """
        counts = df.groupBy(self.id_col).count()
        bad = counts.filter(f"count > 1 OR `{self.id_col}` IS NULL").limit(1).collect()
        if bad:
            raise ValueError(f"{self.name}: {self.id_col} {bad[0][0]} is missing or not unique")
        return df
