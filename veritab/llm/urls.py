"""URL filters: listed canonical addresses, and rules by host and path.

Method: every address gives the keys under which it could be listed (host or a parent domain, and
a beginning of its path). A blocked Bloom filter of the listed keys, of bounded size, lets possible
hits through; an exact hash join with the list removes the false ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.llm.bloom import BlockedBloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LISTED = "host string, path string, verdict string, rule boolean"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    ``listed`` has host, path, verdict, and whether the row is a rule. A row fits its host and all
    subdomains where the path starts with its path. The longest fitting rule decides (of equal
    length, the greatest text); without a rule the longest fitting other row, which is how the
    filter's own list says no; without any, ``default``. A null address, or one without ``://``, has
    an empty host and path. Repeated rows each give a row; null ids stay; an empty list gives
    ``default`` everywhere. A listed row without a host fits nothing.
    """
    listed = listed.filter("host IS NOT NULL AND host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("l_host"), F.coalesce("path", F.lit("")).alias("l_path"),
        F.col("verdict").alias("l_verdict"), F.col("rule").alias("l_rule"),
    )
    listed = listed.withColumn("key", _key(F.col("l_host"), F.col("l_path")))
    # How many labels and how long a path listed rows have: bounded by the longest host and path.
    shapes = [
        (r["labels"], r["chars"])
        for r in listed.select(F.size(F.split("l_host", r"\.")).alias("labels"), F.length("l_path").alias("chars"))
        .distinct().collect()
    ]
    bloom = BlockedBloom.of(listed.select(F.xxhash64("key").alias("hash")).distinct())
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    cut = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")
    )
    labels = F.split("_host", r"\.")
    keys = [
        F.when(
            (F.size(labels) >= n) & (F.length("_path") >= m) & (F.col("_host") != ""),
            _key(F.array_join(F.slice(labels, -n, n), "."), F.substring("_path", 1, m)),
        )
        for n, m in sorted(shapes)
    ]
    keys_of = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    probed = cut.withColumn("keys", keys_of).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            hit = bloom.may_hold(flat)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(hit)])
            hits = pa.ListArray.from_arrays(pa.array(total[bounds], pa.int32()), batch.column("keys").flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), hits], ["_row", "_id", "_host", "_path", "hits"])

    id_type = pages.schema[id_col].dataType.simpleString()
    found = probed.mapInArrow(probe, f"_row long, _id {id_type}, _host string, _path string, hits array<string>")
    exact = (
        found.select("_row", "_id", "_host", "_path", F.explode_outer("hits").alias("key"))
        # Rows without a possible hit get a key of their own that no listed row has.
        .withColumn("key", F.coalesce("key", F.concat(F.lit("/"), F.col("_row").cast("string"))))
        .join(listed, "key", "left")
    )
    text = F.concat("l_host", "l_path")
    order = F.struct(F.col("l_rule"), F.length(text), text, F.col("l_verdict"))
    best = exact.groupBy("_row").agg(
        F.first("_id").alias(id_col), F.first("_host").alias("host"), F.first("_path").alias("path"),
        F.max(F.when(F.col("l_host").isNotNull(), order)).alias("best"),
    )
    return best.select(
        id_col, "host", "path",
        F.when(F.col("best.l_rule"), F.col("best.col3")).alias("rule"),
        F.coalesce(F.col("best.l_verdict"), F.lit(default)).alias("verdict"),
    )


def listed_frame(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, LISTED)
