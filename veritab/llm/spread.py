"""A lookup that stays balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and its number of rows.

    Keys with over a quarter of a shuffle partition's share are matched by a broadcast. Sizes add
    up to ``total``, so there are at most four such keys per partition, whatever the data. All other
    keys go through the shuffle, where none of them is large.
    """
    share = max(1, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(groups.filter(F.col(size) > share))
    cold = groups.filter(F.col(size) <= share)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(groups.filter(F.col(size) > share).select(key)), key, "left_anti").join(cold, key))
