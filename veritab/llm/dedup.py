"""Exact deduplication against a persistent digest index.

Method: the index is a Parquet table bucketed and sorted by digest. New digests are grouped, go
through a sort-merge anti-join with the index, whose side needs no exchange, and what is new is
appended. Texts never take part in a shuffle, only 32-byte digests do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.llm.spread import lookup_by_size
from veritab.session import materialize, scratch_path

#: New texts per bucket that an index is laid out for at most.
BUCKET_ROWS = 4_000_000


def normalized(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and SHA-256 (binary) of each normalised text; a null text counts as empty."""
    return documents.select(id_col, F.unhex(F.sha2(normalized(text_col), 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far with the document that was kept for each.

    ``folder`` lies in a shared place and outlives the session. It holds the digests and, beside them, the
    layout they were written with: the bucket of a digest follows from the number of buckets, so files
    read with another number would hide what they hold. An index that exists is opened with its own
    layout; ``buckets`` is only asked for when it is made (by default the shuffle partitions), and another
    number than the stored one is refused, as is a table of this name that lies elsewhere.
    """

    def __init__(self, spark: SparkSession, table: str, folder: str, buckets: int | None = None):
        self.spark, self.table, self.folder = spark, table, folder
        stored = self._stored_buckets()
        if stored is not None and buckets not in (None, stored):
            raise ValueError(f"the index in {folder} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        data = f"{folder}/digests"
        if spark.catalog.tableExists(table):
            rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
            told = {r["col_name"]: r["data_type"] for r in rows}
            if not told.get("Location", "").endswith(data.split(":", 1)[-1]) or int(told.get("Num Buckets", 0)) != self.buckets:
                raise ValueError(f"table {table} is not the index in {folder}")
            return
        if stored is None:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/layout")
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{data}'"
        )

    def _stored_buckets(self) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/layout")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.folder}/layout").first()["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, new: DataFrame) -> None:
        """Append the digests of ``new`` (digest, keep_id; one row each) that the index lacks."""
        fresh = new.join(self.rows().hint("merge"), "digest", "left_anti").select("digest", "keep_id")
        # Files that an append reads must not change meanwhile: the new rows are written first.
        stored = materialize(fresh)
        stored.repartition(self.buckets, "digest").write.insertInto(self.table)


def new_index(spark: SparkSession, texts: int) -> DigestIndex:
    """An empty index in the shared folder, laid out for so many texts."""
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + texts // BUCKET_ROWS)
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark), buckets)


def deduplicate(
    documents: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 1
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays, unless the index already holds the text: then the id of
    the index stays and all new ones go. group_size counts the rows of ``documents`` with the
    text. A null text equals an empty one; a row without an id never stays unless no other has
    the text (keep_id is then null and kept false). Repeated rows with the kept id are all kept.

    With several ``batches`` the documents go to the index one range of ids after the other, rows
    without an id last, each against what those before it have stored; the result is the same.
    """
    spark = documents.sparkSession
    stored = materialize(digests(documents, id_col, text_col))
    number = F.col(id_col).cast("long")
    batch = F.lit(0)
    if batches > 1:
        low, high = stored.agg(F.min(number), F.max(number)).first()
        bounds = [] if low is None else [low + (high - low + 1) * k // batches for k in range(1, batches)]
        for k, bound in enumerate(bounds, 1):
            batch = F.when(number >= bound, k).otherwise(batch)
        batch = F.when(number.isNull(), batches - 1).otherwise(batch)
    found = stored.groupBy("digest", batch.alias("batch"))
    groups = materialize(found.agg(F.min(number).alias("keep_id"), F.count("*").alias("rows")))
    index = index or new_index(spark, groups.count())
    for k in range(batches):
        index.add(groups.filter(F.col("batch") == k))
    sizes = groups.groupBy("digest").agg(F.sum("rows").alias("group_size"))
    kept = materialize(index.rows().join(sizes, "digest"))
    found = lookup_by_size(stored, kept, "digest", "group_size", stored.count())
    return found.select(
        id_col,
        "keep_id",
        "group_size",
        F.coalesce(F.col(id_col).cast("long") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_row_of(documents: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """One row of ``documents`` for each key of ``wanted`` (columns _0, _1, ...): the smallest as JSON.

    Any column type will do, maps too; each task sends one row per key at most.
    """
    named = documents.select(F.struct(*documents.columns).alias("_row"), *[k.alias(f"_{i}") for i, k in enumerate(keys)])
    same = [named[f"_{i}"].eqNullSafe(wanted[f"_{i}"]) for i in range(len(keys))]
    rows = named.join(wanted, same, "left_semi").groupBy(*[f"_{i}" for i in range(len(keys))])
    return rows.agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")


def without_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_unnamed: bool = False) -> DataFrame:
    """The rows of ``documents`` that ``deduplicate`` keeps, with all their columns.

    With ``keep_unnamed``, exactly one row stays of each text: also of texts that only rows without an id
    hold, and of rows that stand there several times with the id that stays. What goes is a short list
    of (id, digest) as a rule; Spark broadcasts it while it is small. Only texts without an id, and
    those delivered several times, take part in an exchange, one per task and digest.
    """
    marked = deduplicate(documents, None, id_col, text_col)
    if keep_unnamed:
        marked = materialize(marked)
    own = F.unhex("text_sha256")
    leaves = marked.filter(~F.col("kept")).select(F.col(id_col).alias("_0"), own.alias("_1"))
    digest = F.unhex(F.sha2(normalized(text_col), 256))
    keys = [documents[id_col], digest]

    def without(gone: DataFrame) -> DataFrame:
        return documents.join(gone, keys[0].eqNullSafe(gone["_0"]) & (keys[1] == gone["_1"]), "left_anti")

    if not keep_unnamed:
        return without(materialize(leaves.distinct()))
    stays = marked.filter("kept OR keep_id IS NULL").groupBy(F.col(id_col).alias("_0"), own.alias("_1"))
    several = materialize(stays.agg(F.count("*").alias("rows")).filter("rows > 1 OR _0 IS NULL").select("_0", "_1"))
    gone = materialize(leaves.unionByName(several).distinct())
    return without(gone).unionByName(one_row_of(documents, [F.col(id_col), digest], several))
