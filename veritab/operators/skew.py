"""Lookup join that stays balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veritab.session import materialize

#: Words of 64 bits that a bit map has at most: what is broadcast stays that small.
_MOST_WORDS = 1 << 18


def _with_bits(rows: DataFrame, keys: DataFrame, hash_col: str, how: str) -> tuple[DataFrame, Column]:
    """``rows`` joined with a bit map of ``keys``, and whether a row's bit is set.

    There are 16 bits for each key as far as the bound allows; beyond that more bits are set, and more rows pass.
    """
    words = min(_MOST_WORDS, 1 << max(0, keys.count() // 4).bit_length())
    word = F.pmod(F.shiftright(hash_col, 6), F.lit(words))
    bit = F.expr(f"shiftleft(1L, CAST(`{hash_col}` & 63 AS INT))")
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word", how), F.col("_bits").bitwiseAND(bit) != 0


def possible(rows: DataFrame, keys: DataFrame, hash_col: str) -> DataFrame:
    """The rows whose 64-bit ``hash_col`` may be one of ``keys``: all that are, and a few others; no exchange."""
    joined, is_set = _with_bits(rows, keys, hash_col, "inner")
    return joined.filter(is_set).select(*rows.columns)


def sparse_lookup(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Left join with a table that has a small part of the keys; only rows whose key may be there are exchanged."""
    few = materialize(few)
    keys = few.select(F.xxhash64(on).alias("_hash"))
    joined, is_set = _with_bits(rows.withColumn("_hash", F.xxhash64(on)), keys, "_hash", "left")
    tagged = joined.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("_maybe"))
    met = tagged.filter("_maybe").drop("_maybe").join(few, on, "left")
    rest = tagged.filter("NOT _maybe").drop("_maybe").select(
        *rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name != on]
    )
    return met.unionByName(rest)


def heavy_lookup(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str, spread_by: str
) -> DataFrame:
    """Left join ``rows`` with ``lookup``, which has one row per key (NULL keys match NULL).

    ``weight`` is the number of rows of each key. Keys with over a quarter of a shuffle
    partition's share of all weight are matched by a broadcast; there are at most four of them for
    each partition, whatever the data. In the second, shuffled join their rows carry a hash of
    the record instead of one of the key, so they match nothing and are spread evenly. The lookup
    is written once, since both joins read it.
    """
    payload = [c for c in lookup.columns if c not in on]
    stored = materialize(
        lookup.select(
            *[F.col(c).alias(f"_k_{c}") for c in on],
            *[F.col(c).alias(f"_p_{c}") for c in payload],
            F.xxhash64(*on).alias("_place"),
        )
    )
    total = stored.agg(F.sum(f"_p_{weight}")).first()[0] or 0
    share = total / (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heaviest = stored.filter(F.col(f"_p_{weight}") > share)

    def same_key(side: DataFrame, other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [side[c].eqNullSafe(other[f"_k_{c}"]) for c in on])

    hot = heaviest.select("*", F.lit(True).alias("_hot")).drop("_place")
    tagged = rows.join(F.broadcast(hot), same_key(rows, hot), "left").select(
        *rows.columns,
        *[F.col(f"_p_{c}").alias(f"_h_{c}") for c in payload],
        F.coalesce("_hot", F.lit(False)).alias("_hot"),
        # Both branches are hashes of columns: a constant here would be folded out of the join
        # key, and the heavy rows would meet in one task again.
        F.when(F.col("_hot"), F.xxhash64(spread_by)).otherwise(F.xxhash64(*on)).alias("_spread"),
    )
    matched = tagged.join(
        stored,
        (tagged["_spread"] == stored["_place"]) & same_key(tagged, stored) & ~tagged["_hot"],
        "left",
    )
    return matched.select(
        *rows.columns, *[F.coalesce(f"_h_{c}", f"_p_{c}").alias(c) for c in payload]
    )
