"""veritab: find, label and score data errors in Spark tables of any size."""

from veritab.spec import TableSpec, UnitChange

__all__ = ["TableSpec", "UnitChange"]
