"""Exact random picks of k rows, found as a cutoff on their md5 draw.

The k rows with the smallest draws are the rows at or below the k-th smallest draw. Finding
that one value takes a few counting passes and no sort; afterwards "is this row picked" is a
plain comparison with a literal, so picking needs no join and no shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_STEP = 3  # hex digits refined per pass: at most 16**3 counters reach the driver
_FETCH = 20_000  # digests of one boundary prefix fetched for the last step


def _prefix_counts(digests: DataFrame, prefix: str) -> list[tuple[str, int]]:
    if prefix:
        digests = digests.filter(F.col("digest").startswith(prefix))
    step = F.substring("digest", 1, len(prefix) + _STEP)
    rows = digests.groupBy(step.alias("prefix")).count().collect()
    return sorted((r["prefix"], r["count"]) for r in rows)


def digest_cutoffs(df: DataFrame, digest: Column, ks: Sequence[int]) -> list[str]:
    """The k-th smallest digest for each k; ``df`` must hold at least ``max(ks)`` rows."""
    digests = df.select(digest.alias("digest"))
    first = _prefix_counts(digests, "")
    total = sum(n for _, n in first)
    if total < max(ks):
        raise ValueError(f"cannot pick {max(ks)} of {total} candidates")
    places = []  # per k: the prefix that holds the k-th digest, and its rank there
    for k in ks:
        remaining, counts = k, first
        while k > 0:
            for prefix, n in counts:
                if remaining <= n:
                    break
                remaining -= n
            if n <= _FETCH or len(prefix) >= 30:
                break
            counts = _prefix_counts(digests, prefix)
        places.append((prefix, remaining) if k > 0 else ("", 0))
    wanted = [F.col("digest").startswith(p) for p in sorted({p for p, _ in places if p})]
    if not wanted:
        return ["" for _ in ks]
    rows = digests.filter(reduce(lambda a, b: a | b, wanted)).collect()
    near = sorted(r["digest"] for r in rows)
    return [
        [d for d in near if d.startswith(prefix)][rank - 1] if prefix else ""
        for prefix, rank in places
    ]
