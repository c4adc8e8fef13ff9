"""Text expressions: misspellings and format checks, all native column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from veritab.functions.hashing import draw_fraction, text

# Java's \s knows ASCII only; (?U) widens it to every Unicode space.
EDGE_SPACE = r"(?U)^\s|\s$"


def has_edge_space(value: Column) -> Column:
    return value.rlike(EDGE_SPACE)


def has_case_mismatch(value: Column) -> Column:
    return value != F.lower(value)


def differs_by_case_only(value: Column, allowed: Sequence[str]) -> Column:
    """Not an allowed label as written, but equal to one when case is ignored."""
    return ~value.isin(*allowed) & F.lower(value).isin(*[a.lower() for a in allowed])


def edit_distance_to(value: Column, allowed: Sequence[str]) -> Column:
    """Fewest single-character edits to any allowed label; 0 for missing or empty text."""
    distances = [F.levenshtein(value, F.lit(a)) for a in allowed]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    return F.when(value.isNull() | (value == ""), F.lit(0)).otherwise(nearest)


def misspell(value: str, allowed_anywhere: Sequence[str], digest: str) -> str:
    """A misspelling of ``value`` that is not a valid label of any column.

    Four kinds are equally likely: swap two neighbours, drop a character, change case, add a
    space at an end; places within a kind are uniform. So a rewrite weighs 1 / (rewrites of its
    kind). Drawing again after an invalid result is the same as drawing once among the valid
    ones by weight, which is what this does with the md5 ``digest``. Expression text in and out.
    """
    v = value
    swaps = (
        f"transform(slice(sequence(1, greatest(length({v}), 1)), 1, greatest(length({v}) - 1, 0)), i -> "
        f"concat(substr({v}, 1, i - 1), substr({v}, i + 1, 1), substr({v}, i, 1), substr({v}, i + 2)))"
    )
    drops = (
        f"transform(sequence(1, greatest(length({v}), 1)), i -> "
        f"concat(substr({v}, 1, i - 1), substr({v}, i + 1)))"
    )
    cases = f"array(concat(upper(substr({v}, 1, 1)), lower(substr({v}, 2))), upper({v}))"
    spaces = f"array(concat({v}, ' '), concat(' ', {v}))"
    unusable = ", ".join([v, "''", *[text(a) for a in allowed_anywhere]])
    options = (
        f"flatten(transform(array({swaps}, {drops}, {cases}, {spaces}), kind -> "
        f"transform(filter(kind, t -> t NOT IN ({unusable})), "
        "t -> named_struct('text', t, 'weight', 1.0D / size(kind)))))"
    )
    # The one-element transform names the options once for the sum and the walk.
    mass = "aggregate(options, 0.0D, (total, o) -> total + o.weight)"
    walk = (
        f"aggregate(options, named_struct('left', {draw_fraction(digest)} * {mass}, "
        "'text', CAST(NULL AS STRING)), (at, o) -> named_struct('left', at.left - o.weight, "
        "'text', CASE WHEN at.text IS NULL AND at.left < o.weight THEN o.text ELSE at.text END))"
    )
    return (
        f"element_at(transform(array({options}), options -> "
        f"coalesce({walk}.text, try_element_at(options, -1).text)), 1)"
    )
