"""Seeded draws, written as SQL expression text.

Every random choice is the md5 of ``seed|stage|keys``. A draw therefore depends on the row
alone, never on how rows are spread over partitions, and a recomputed task repeats it.
The functions take and return expression text, for ``F.expr`` and ``selectExpr``.
"""

from __future__ import annotations

from collections.abc import Sequence

_HEX_DIGITS = 15
_DRAW_RANGE = 16**_HEX_DIGITS


def column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def draw(seed: int, stage: str, *keys: str) -> str:
    parts = ", ".join(f"CAST({k} AS STRING)" for k in keys)
    return f"md5(concat_ws('|', '{int(seed)}', {text(stage)}, {parts}))"


def draw_integer(digest: str) -> str:
    return f"CAST(conv(substring({digest}, 1, {_HEX_DIGITS}), 16, 10) AS BIGINT)"


def draw_fraction(digest: str) -> str:
    """Uniform in [0, 1)."""
    return f"({draw_integer(digest)} / {float(_DRAW_RANGE)!r}D)"


def draw_index(digest: str, size: int | str) -> str:
    """Uniform 0-based index below ``size``, a number or expression text."""
    return f"({draw_integer(digest)} % {size})"


def draw_item(digest: str, items: Sequence[float]) -> str:
    """One of a short list of numbers."""
    values = ", ".join(f"{float(i)!r}D" for i in items)
    return f"element_at(array({values}), CAST({draw_index(digest, len(items))} + 1 AS INT))"
