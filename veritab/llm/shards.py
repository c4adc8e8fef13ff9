"""Word ids for a whole corpus without a shared dictionary in any task.

Texts are cut into shards, each with its own small vocabulary and its texts as local word ids. The
vocabularies alone are exchanged: they are counted, words get ids of the corpus, and every shard gets
the ids of its own words back. A word takes part once per shard, however often it stands there, so no
word is a hot key; texts are tokenised once.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tokens after which a shard is closed; whole texts only.
SHARD_TOKENS = 4_000_000
#: Bytes of a text that are tokenised at once; the cut is made at white space.
SEGMENT = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")
SHARD_SCHEMA = (
    "shard string, words array<binary>, counts array<long>, stream binary, "
    "ids array<long>, lengths array<int>, counted array<boolean>"
)


def packed(values: np.ndarray) -> bytes:
    """Non-negative whole numbers (or -1) as compressed planes of bytes."""
    plain = np.ascontiguousarray(values, np.int64)
    planes = np.ascontiguousarray(plain.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return packed(np.diff(values.astype(np.int64), prepend=0))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about SEGMENT bytes; a part ends before white space, never in a word."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = WHITE.search(text, start + SEGMENT)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class _Shard:
    """Words of one shard by prefix, numbered in order of appearance."""

    def __init__(self, breaks: bytes):
        self.number = itertools.count().__next__
        self.breaks = breaks
        self.words: dict[bytes, defaultdict] = {}
        self.streams: list[np.ndarray] = []
        self.ids: list = []
        self.counted: list[bool] = []
        self.tokens = 0

    def vocabulary(self, prefix: bytes) -> defaultdict:
        if prefix not in self.words:
            self.words[prefix] = defaultdict(self.number)
            self.words[prefix].update((bytes([b]), -1) for b in self.breaks)
        return self.words[prefix]

    def add(self, key, prefix: bytes, text: bytes, counted: bool, find: Callable, end: bytes | None) -> None:
        place = self.vocabulary(prefix).__getitem__
        parts = []
        for part in segments(text):
            tokens = find(part)
            parts.append(np.fromiter(map(place, tokens), np.int32, len(tokens)))
        parts.append(np.array([-1 if end is None else place(end)], np.int32))
        stream = np.concatenate(parts)
        self.streams.append(stream)
        self.ids.append(key)
        self.counted.append(counted)
        self.tokens += len(stream)

    def row(self, name: str) -> pa.RecordBatch:
        listed = sorted((i, prefix + word) for prefix, words in self.words.items() for word, i in words.items() if i >= 0)
        lengths = np.array([len(s) for s in self.streams], np.int32)
        stream = np.concatenate(self.streams)
        inside = np.repeat(np.array(self.counted), lengths) & (stream >= 0)
        counts = np.bincount(stream[inside], minlength=len(listed))
        columns = [
            pa.array([name]), pa.array([[w for _, w in listed]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
            pa.array([packed(stream)], pa.binary()), pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int32())), pa.array([self.counted], pa.list_(pa.bool_())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "words", "counts", "stream", "ids", "lengths", "counted"])


def shard_texts(
    documents: DataFrame,
    text: Column,
    pattern: bytes,
    *,
    breaks: bytes = b"",
    key: Column | None = None,
    prefix: Column | None = None,
    counted: Column | None = None,
    end: bytes | None = None,
) -> DataFrame:
    """Shards of ``documents``; to be written before use, because their names come from the tasks.

    ``pattern`` finds words and the single bytes of ``breaks`` in the text, A-Z lower-cased. ``stream``
    holds local word ids; -1 is a break, and stands behind every text unless ``end`` names a word that
    stands there instead. ``prefix`` goes before the words in the vocabulary, so that equal words of
    different prefixes are different. Only texts with ``counted`` add to ``counts``. Null texts are
    empty. A text lies in one shard, so memory follows the longest text.
    """
    rows = documents.select(
        (F.lit(None).cast("long") if key is None else key.cast("long")).alias("key"),
        (F.lit("") if prefix is None else prefix).cast("binary").alias("prefix"),
        (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"),
        F.coalesce(text, F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = re.compile(pattern).findall, itertools.count()
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        shard = _Shard(breaks)
        for batch in batches:
            keys, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(len(batch)):
                text_bytes = batch.column(3)[i].as_py().lower()  # of bytes: changes A-Z only
                shard.add(keys[i], batch.column(1)[i].as_py(), text_bytes, flags[i], find, end)
                if shard.tokens >= SHARD_TOKENS:
                    yield shard.row(f"{task}-{next(number)}")
                    shard = _Shard(breaks)
        if shard.ids:
            yield shard.row(f"{task}-{next(number)}")

    return rows.mapInArrow(run, SHARD_SCHEMA)


def word_counts(shards: DataFrame) -> DataFrame:
    """(word, count) over all shards; words that only uncounted texts hold have count 0."""
    each = shards.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return each.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("count"))


def with_ids(words: DataFrame) -> DataFrame:
    """``words`` with ``id``: whole numbers from 0 with few gaps, dealt by the words' hashes.

    Each hash bucket numbers its own words, so nothing is ranked as a whole.
    """
    buckets = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("word")) - 1
    return words.withColumn("_bucket", bucket).withColumn("id", rank * F.lit(buckets) + F.col("_bucket")).drop("_bucket")


def over_shards(shards: DataFrame, words: DataFrame, function: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``function`` on every shard: its row, and arrays ``pos``, ``id``, ``count`` of the words that have an id."""
    held = shards.select(F.col("shard").alias("owner"), F.posexplode("words").alias("pos", "word"))
    own = held.join(words, "word").select("owner", "pos", "id", "count")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):  # no shard, no words
            return function({}, {})
        found = {c: right[c].to_numpy() for c in ("pos", "id", "count")}
        return function({c: left[c][0].as_py() for c in left.column_names}, found)

    rows = shards.drop("words", "counts").groupBy("shard")
    return rows.cogroup(own.groupBy("owner")).applyInArrow(run, schema)


def global_stream(row: dict, words: dict, missing: int) -> np.ndarray:
    """The shard's stream with the ids of the corpus; ``missing`` where a word has none, -1 at breaks."""
    stream = unpacked(row["stream"])
    table = np.full(int(stream.max(initial=0)) + 2, missing, np.int64)
    table[words["pos"]] = words["id"]
    table[-1] = -1
    return table[stream]
