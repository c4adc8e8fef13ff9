"""Exact interpolated quantiles from mergeable sketches and one exact count or two.

A first scan makes a KLL sketch of every column (Karnin, Lang and Liberty, "Optimal Quantile Approximation
in Streams", 2016): one per task, merged group by group and then once more, so that no task meets the
sketches of all others. The sketch brackets each wanted rank by two values of the column, whatever the
values are. The next scan counts exactly how many rows lie below the bracket, at its ends and inside,
and fetches the values inside if they are few; otherwise it makes a sketch of these, for the next
bracket. A bracket holds about 1 / ``NARROWING`` of the rows, so two scans settle a million rows and three
some hundred millions; ties and outliers add none. All columns and ranks share their scans.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

#: Size of a sketch; its ranks are off by ``RANK_ERROR`` of the rows with odds of one in a hundred.
SKETCH = 4096
RANK_ERROR = 2.296 / SKETCH**0.9021
#: How far a bracket reaches to either side of a rank, in rank errors.
REACH = 2.0
NARROWING = 1 / (2 * (REACH + 1) * RANK_ERROR)
#: The inside of a bracket with so few rows is fetched.
FETCH = 20_000


@dataclass(frozen=True)
class _Domain:
    """``rows`` values of a column that lie together in its order, with their sketch; ``below`` are smaller."""

    column: str
    below: int
    rows: int
    sketch: bytes


@dataclass(frozen=True)
class _Bracket:
    """Two values of a domain that should hold a rank between them, and whether what is inside is fetched."""

    domain: _Domain
    low: float
    high: float
    fetch: bool


def _merged(df: DataFrame, counts: Mapping[str, Column], sketches: Mapping[str, Column], lists: Mapping[str, Column]) -> Row:
    """One row: sums of flags, sketches and lists over the whole table, in two levels."""
    groups = math.isqrt(max(0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)) + 1
    group = F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_group")
    own = df.groupBy(group).agg(
        *[F.count(F.when(flag, 1)).alias(n) for n, flag in counts.items()],
        *[F.kll_sketch_agg_double(v, SKETCH).alias(n) for n, v in sketches.items()],
        *[F.collect_list(v).alias(n) for n, v in lists.items()],
    )
    return own.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        *[F.kll_merge_agg_double(n, SKETCH).alias(n) for n in sketches],
        *[F.flatten(F.collect_list(n)).alias(n) for n in lists],
    ).first()


def _values_at(df: DataFrame, domain: _Domain, shares: Sequence[float]) -> list[float]:
    """The sketch's values at shares of the domain, 0 and 1 being its exact ends."""
    row = df.sparkSession.range(1).select(
        F.kll_sketch_get_quantile_double(F.lit(domain.sketch), F.array(*[F.lit(float(s)) for s in shares]))
    )
    return list(row.first()[0])


def _brackets(df: DataFrame, open_ranks: Mapping[_Domain, set[int]], reach: float) -> dict[_Bracket, set[int]]:
    out: dict[_Bracket, set[int]] = {}
    for domain, ranks in open_ranks.items():
        margin, shares = reach * RANK_ERROR, []
        for rank in sorted(ranks):
            at = (rank - domain.below) / max(1, domain.rows - 1)
            low, high = max(0.0, at - margin), min(1.0, at + margin)
            if shares and low <= shares[-1][1]:
                shares[-1] = (shares[-1][0], high, shares[-1][2] | {rank})
            else:
                shares.append((low, high, {rank}))
        found = _values_at(df, domain, [s for low, high, _ in shares for s in (low, high)])
        for i, (low, high, held) in enumerate(shares):
            # What lies strictly between the two values is this much of the domain at most.
            expected = min(1.0, high - low + 2 * RANK_ERROR) * domain.rows
            bracket = _Bracket(domain, found[2 * i], found[2 * i + 1], expected <= FETCH)
            out[bracket] = out.get(bracket, set()) | held
    return out


def _settle(df: DataFrame, values: Mapping[str, Column], brackets: Mapping[_Bracket, set[int]]) -> tuple[dict[tuple[str, int], float], dict[_Domain, set[int]], bool]:
    """One scan: the ranks that are known now, the domains of those that are not, and whether any was missed."""
    counts, sketches, lists = {}, {}, {}
    for i, b in enumerate(brackets):
        value = values[b.domain.column]
        counts |= {f"below{i}": value < b.low, f"low{i}": value == b.low}
        if b.low < b.high:
            between = (value > b.low) & (value < b.high)
            counts |= {f"high{i}": value == b.high, f"mid{i}": between}
            (lists if b.fetch else sketches)[f"in{i}"] = F.when(between, value)
    row = _merged(df, counts, sketches, lists)
    known: dict[tuple[str, int], float] = {}
    left: dict[_Domain, set[int]] = {}
    missed = False
    for i, (b, ranks) in enumerate(brackets.items()):
        column, wide = b.domain.column, b.low < b.high
        start, at_low = row[f"below{i}"], row[f"low{i}"]
        mid, at_high = (row[f"mid{i}"], row[f"high{i}"]) if wide else (0, 0)
        fetched = sorted(row[f"in{i}"]) if wide and b.fetch else []
        for rank in ranks:
            place = rank - start
            if 0 <= place < at_low:
                known[column, rank] = b.low
            elif at_low <= place < at_low + mid and b.fetch:
                known[column, rank] = fetched[place - at_low]
            elif at_low <= place < at_low + mid:
                inner = _Domain(column, start + at_low, mid, bytes(row[f"in{i}"]))
                left.setdefault(inner, set()).add(rank)
            elif at_low + mid <= place < at_low + mid + at_high:
                known[column, rank] = b.high
            else:  # the sketch was further off than it is as a rule
                left.setdefault(b.domain, set()).add(rank)
                missed = True
    return known, left, missed


def quantiles(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """One list per column, in the order of ``probabilities``; missing values (NULL, NaN) don't count.

    An empty column has None throughout. Ranks between two values are interpolated.
    """
    # Adding 0 turns -0.0 into 0.0, which the sketch would tell apart.
    values = {name: F.when(~F.isnan(value.cast("double")), value.cast("double") + 0.0) for name, value in values.items()}
    if not values:
        return {}
    names = list(values)
    row = _merged(
        df, {f"n{i}": values[c].isNotNull() for i, c in enumerate(names)}, {f"s{i}": values[c] for i, c in enumerate(names)}, {}
    )
    whole = {c: _Domain(c, 0, row[f"n{i}"], bytes(row[f"s{i}"])) for i, c in enumerate(names) if row[f"n{i}"]}
    places = {c: [p * (d.rows - 1) for p in probabilities] for c, d in whole.items()}
    left: dict[_Domain, set[int]] = {whole[c]: {r for x in xs for r in (math.floor(x), math.ceil(x))} for c, xs in places.items() if xs}
    at: dict[tuple[str, int], float] = {}
    reach = REACH
    while left:
        known, left, missed = _settle(df, values, _brackets(df, left, reach))
        at |= known
        reach = 2 * reach if missed else reach
    out: dict[str, list[float | None]] = {name: [None] * len(probabilities) for name in values}
    for name, found in places.items():
        for k, x in enumerate(found):
            lower, upper = at[name, math.floor(x)], at[name, math.ceil(x)]
            out[name][k] = lower + (upper - lower) * (x - math.floor(x)) if lower < upper else lower
    return out


def quantile_frame(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]) -> DataFrame:
    """The same as (column, probability, value) rows."""
    found = quantiles(df, values, probabilities)
    rows = [(name, float(p), found[name][k]) for name in found for k, p in enumerate(probabilities)]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")
