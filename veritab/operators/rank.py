"""Global ranks and running totals without sorting a table in one task.

Rows are spread over order-preserving buckets, each bucket is numbered on its own, and the
bucket's offset (the rows in all earlier buckets) is added. The offsets are one row per bucket,
a few thousand at most, which is the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veritab.session import materialize

#: Buckets for each shuffle partition, so that work spreads as far as the session allows.
BUCKETS_PER_PARTITION = 4


def bucket_count(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_buckets(df: DataFrame, column: str, name: str = "bucket", buckets: int | None = None) -> DataFrame:
    """Add an order-preserving bucket number with about the same share of rows in each.

    The edges are approximate quantiles. Whether they are accurate changes how evenly the work
    is spread, never a result.
    """
    buckets = buckets or bucket_count(df)
    as_double = df.withColumn("_edge_value", F.col(column).cast("double"))
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(as_double.approxQuantile("_edge_value", probabilities, 0.5 / buckets)))
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *edges, float("inf")]
    spread = Bucketizer(splits=splits, inputCol="_edge_value", outputCol=name, handleInvalid="keep")
    return spread.transform(as_double).drop("_edge_value")


def bucket_offsets(df: DataFrame, bucket: str, amount: Column, within: Sequence[str] = ()) -> DataFrame:
    """Per bucket: the total of ``amount`` over all earlier buckets (of the same group)."""
    earlier = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return df.groupBy(*within, bucket).agg(amount.alias("_amount")).select(
        *within, bucket, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_offset")
    )


def bucketed_rank(df: DataFrame, bucket: str, order_by: Sequence, name: str) -> DataFrame:
    """1-based global rank by (bucket, order_by)."""
    offsets = F.broadcast(bucket_offsets(df, bucket, F.count(F.lit(1))))
    place = F.row_number().over(W.partitionBy(bucket).orderBy(*order_by))
    return (
        df.withColumn("_place", place)
        .join(offsets, bucket)
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_offset", "_place")
    )


def digest_rank(df: DataFrame, digest: str, name: str) -> DataFrame:
    """Rank by an md5 column: equal steps of its leading digits are even, ordered buckets.

    The rows are often those with the smallest draws, so the steps divide what occurs.
    """
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    last = df.agg(F.max(place)).first()[0] or 0
    step = last // bucket_count(df) + 1
    return bucketed_rank(
        df.withColumn("_prefix", F.floor(place / step).cast("bigint")), "_prefix", [digest], name
    ).drop("_prefix")


def running_total(df: DataFrame, order_by: str, amount: str, name: str) -> DataFrame:
    """Total of ``amount`` over rows with a strictly smaller ``order_by`` (which is unique)."""
    spread = range_buckets(df, order_by, "_bucket")
    offsets = F.broadcast(bucket_offsets(spread, "_bucket", F.sum(amount)))
    before = W.partitionBy("_bucket").orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)
    return (
        spread.withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0)))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_before"))
        .drop("_bucket", "_before", "_offset")
    )


def rank_within(df: DataFrame, group: str, order_by: str, name: str) -> DataFrame:
    """1-based rank by ``order_by`` inside each group, also when one group is most of the table."""
    spread = range_buckets(df, order_by, "_bucket")
    offsets = bucket_offsets(spread, "_bucket", F.count(F.lit(1)), within=[group])
    place = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(order_by))
    return (
        spread.withColumn("_place", place)
        .join(offsets, [group, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )


def ordered_index(df: DataFrame, order_by: Sequence, name: str) -> tuple[DataFrame, int]:
    """0-based index in the order of several columns, and the number of rows.

    A range exchange on the whole key makes the buckets, with the scan position as last key so
    that even identical rows are spread. The exchange samples its bounds, so its outcome is
    written once and numbered from the copy. That copy comes back as the result's source.
    """
    position = "_position"
    spread = (
        df.withColumn(position, F.monotonically_increasing_id())
        .repartitionByRange(*order_by, position)
        .withColumn("_bucket", F.spark_partition_id())
    )
    stored = materialize(spread)
    ranked = bucketed_rank(stored, "_bucket", [*order_by, position], name)
    return (
        ranked.withColumn(name, F.col(name) - 1).drop("_bucket", position),
        stored.count(),
    )
