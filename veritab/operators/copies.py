"""Exact copies: which records are identical, which came first, and how many came before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veritab.operators.rank import rank_within
from veritab.operators.skew import heavy_lookup, possible
from veritab.session import materialize

_DIGEST, _HASH = "_digest", "_hash"


def _record_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """A record's values with their lengths, so that different records differ.

    Missing equals missing; -0.0 equals 0.0.
    """
    types = {f.name: f.dataType for f in df.schema}

    def written(name: str) -> Column:
        value = F.col(name)
        if isinstance(types[name], (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(types[name])
        shown = F.hex(value) if isinstance(types[name], T.BinaryType) else value.cast("string")
        return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.concat(*map(written, columns))


def record_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a record's values."""
    return F.unhex(F.sha2(_record_text(df, columns), 256))


def copied_rows(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(id, n_rows, first_id) of every row that equals another one on ``columns``.

    Of all records, 8-byte hashes are counted within each task first and exchanged once. Only records whose hash
    occurs again go on, as ids and 32-byte digests. Groups are looked up with :func:`heavy_lookup`, so a
    record copied a billion times is still one partial count per task.
    """
    hashed = df.withColumn(_HASH, F.xxhash64(_record_text(df, columns)))
    again = materialize(hashed.groupBy(_HASH).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_HASH))
    keyed = possible(hashed, again, _HASH).select(id_col, record_digest(df, columns).alias(_DIGEST))
    groups = (
        keyed.groupBy(_DIGEST)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("first_id"))
        .filter("n_rows > 1")
    )
    found = heavy_lookup(keyed, groups, [_DIGEST], "n_rows", id_col)
    return found.filter("n_rows is not null").select(id_col, "n_rows", "first_id")


def later_copies(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(id, first_id) of every row but the first-entered of its group of copies."""
    return (
        copied_rows(df, columns, id_col)
        .filter(F.col(id_col) != F.col("first_id"))
        .select(id_col, "first_id")
    )


def copy_counts(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(id, n_exact_copies, n_earlier_copies) of the rows that have copies."""
    ranked = rank_within(copied_rows(df, columns, id_col), "first_id", id_col, "place")
    return ranked.select(
        id_col,
        (F.col("n_rows") - 1).alias("n_exact_copies"),
        (F.col("place") - 1).cast("bigint").alias("n_earlier_copies"),
    )
