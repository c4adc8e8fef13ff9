"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="veritab-")
        sc.setCheckpointDir(folder)
    return folder


#: Paths handed out within ``removed_after``, innermost last; each thread has its own.
_owned: ContextVar[tuple[list[str], ...]] = ContextVar("owned", default=())


def scratch_path(spark: SparkSession) -> str:
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    if _owned.get():
        _owned.get()[-1].append(path)
    return path


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside when the block ends; nothing that reads them may leave it."""
    paths: list[str] = []
    token = _owned.set((*_owned.get(), paths))
    try:
        yield
    finally:
        _owned.reset(token)
        remove_paths(spark, paths)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy is columnar, so later readers still prune columns and push filters down, and it
    outlives the executors that wrote it.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task of their own.
TASK_ROWS = 20_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more tasks than they are worth; never fewer than keep all cores busy.

    A shuffle leaves as many partitions as the session sets, and a step on a small table would start a task, a
    worker and a file for each of them. Partitions are only read one after the other: no exchange, all rows stay.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


#: Smaller tables are not worth an exchange.
_SPREAD_FROM = 100_000


def spread_evenly(df: DataFrame, key: str) -> DataFrame:
    """``df``, written anew if most of its rows are read by so few tasks that executors would idle in every scan.

    A file is split at its row groups only. How many rows each task gets is counted, for which no column is read.
    """
    spark = df.sparkSession
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    cores, rows = spark.sparkContext.defaultParallelism, sum(sizes)
    if rows < _SPREAD_FROM or max(sizes) * cores <= 2 * rows:
        return df
    return materialize(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))


def discard(stored: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote; nothing may read it any more.

    What was made of it must have been written too: a lost task could not be run again otherwise.
    """
    folders = {file.rsplit("/", 1)[0] for file in stored.inputFiles()}
    remove_paths(stored.sparkSession, sorted(folders))
