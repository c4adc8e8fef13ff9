"""Packed id matrices for training, written by every task for its own documents.

Method: best-fit decreasing with a segment tree over capacities. Each task encodes its documents,
cuts overlong ones losslessly and packs windows of at most ``WINDOW`` tokens: the tree finds the
smallest free capacity that holds a piece. No token ever crosses the network; what a window costs
is at most its last, partly filled sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.bpe import encoder, texts_of

LIMIT = 1024
END = 2
#: Tokens that a task gathers before it packs; 4 bytes each.
WINDOW = 1 << 21
#: Sequences that a task hands over at a time; 8 kB each with their positions.
BATCH = 512

MATRIX = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, "
    "doc_ids array<long>, starts array<long>"
)
#: Columns of the written files.
WRITTEN = (
    "sequence_id long, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, "
    "input_ids binary, positions binary"
)


class CapacityTree:
    """Counts open bins by free capacity; finds the smallest capacity of at least a size."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.count = [0] * (2 * self.width)

    def change(self, capacity: int, by: int) -> None:
        at = self.width + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def at_least(self, size: int) -> int | None:
        at = self.width + size
        if self.count[at]:
            return size
        while at > 1:  # up to the first right neighbour that holds a bin, then down to its leftmost
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; the order within a bin is that of placing."""
    tree, bins = CapacityTree(limit), []
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tree.at_least(size)
        if room is None:
            room, chosen = limit, len(bins)
            bins.append([])
        else:
            chosen = open_bins[room].pop()
            tree.change(room, -1)
        bins[chosen].append(i)
        open_bins[room - size].append(chosen)
        tree.change(room - size, 1)
    return bins


def packed_sequences(documents: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text", padded: bool = False) -> DataFrame:
    """One row per sequence: its ids (uint32, little-endian), segment bounds, documents and starts.

    ``cu_seqlens`` begins with 0 and ends with n_tokens; ``starts`` says where each segment begins
    in its document. A null text is empty and gives the end id alone; a null id gives a null in
    ``doc_ids``; an empty table gives no rows; repeated rows are packed each on their own. With
    ``padded`` the rows are those that ``write_matrices`` writes, made in the same worker.
    """

    def pack(owners: list, ids: list[np.ndarray], base: int) -> Iterator[tuple]:
        piece_owner, piece_start, parts = [], [], []
        for owner, own in zip(owners, ids):
            for at in range(0, len(own), limit):
                piece_owner.append(owner)
                piece_start.append(at)
                parts.append(own[at : at + limit])
        for k, chosen in enumerate(best_fit_decreasing(np.array(list(map(len, parts)), np.int64), limit)):
            row = np.concatenate([parts[i] for i in chosen]).astype("<u4")
            bounds = np.concatenate([[0], np.cumsum([len(parts[i]) for i in chosen])])
            yield (
                base + k, len(row), row.tobytes(), bounds.tolist(),
                [piece_owner[i] for i in chosen], [piece_start[i] for i in chosen],
            )

    types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "doc_ids", "starts"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
        return with_positions(batch, limit) if padded else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        owners: list = []
        ids: list[np.ndarray] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, tokens
            rows: list[tuple] = []
            for row in pack(owners, ids, base):
                rows.append(row)
                base += 1
                if len(rows) == BATCH:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            owners.clear()
            ids.clear()
            tokens = 0

        for batch in batches:
            for a, b, flat, bounds in encoder(path).encode(texts_of(batch, text_col)):
                names_of = batch.column(id_col)[a:b].to_pylist()
                for owner, x, y in zip(names_of, bounds[:-1].tolist(), bounds[1:].tolist()):
                    owners.append(owner)
                    ids.append(np.append(flat[x:y], np.uint32(end)))
                    tokens += y - x + 1
                    if tokens >= WINDOW:
                        yield from flush()
        if owners:
            yield from flush()

    return documents.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, WRITTEN if padded else MATRIX)


def with_positions(batch: pa.RecordBatch, limit: int = LIMIT, pad: int = 0) -> pa.RecordBatch:
    """Sequences with padded ids and a row of positions each, in the order of ``WRITTEN``."""
    filler = np.uint32(pad).astype("<u4").tobytes() * limit
    rows = [(x + filler)[: 4 * limit] for x in batch.column("input_ids").to_pylist()]
    places = [positions(b, limit).tobytes() for b in batch.column("cu_seqlens").to_pylist()]
    kept = [c for c in batch.schema.names if c != "input_ids"]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in kept), pa.array(rows, pa.binary()), pa.array(places, pa.binary())],
        [*kept, "input_ids", "positions"],
    )


def write_matrices(sequences: DataFrame, path: str, limit: int = LIMIT, pad: int = 0) -> None:
    """Write the sequences as rows of a fixed-size id matrix with bounds and position resets.

    Parquet files with ``input_ids`` (limit x uint32, padded), ``positions`` (limit x uint32 that
    begin again with 0 at every segment), ``cu_seqlens`` and what belongs to each segment. Sequences
    that are padded already are written as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield with_positions(batch.slice(at, BATCH), limit, pad)

    padded = sequences if "positions" in sequences.columns else sequences.mapInArrow(run, WRITTEN)
    padded.write.option("compression", "zstd").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The written rows, with the padding cut off again."""
    return spark.read.schema(WRITTEN).parquet(path).withColumn("input_ids", F.expr("substring(input_ids, 1, 4 * n_tokens)"))


def positions(bounds: list[int], limit: int) -> np.ndarray:
    """Place of every token in its segment; the padding counts as one more segment."""
    out = np.arange(limit, dtype=np.int64)
    edges = np.array([*bounds, limit], np.int64)
    return (out - np.repeat(edges[:-1], np.diff(edges))).astype("<u4")


def sequence_digests(sequences: DataFrame) -> DataFrame:
    """The sequences with CRC-32 of ids in place of the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column("input_ids").to_pylist()], pa.int64())
            kept = [c for c in batch.schema.names if c != "input_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), crc], [*kept, "ids_crc32"])

    schema = "sequence_id long, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, ids_crc32 long"
    return sequences.mapInArrow(run, schema)


def matrix_digests(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written matrices with CRC-32 of the ids and of the whole row of positions."""
    return read_matrices(spark, path).select(
        "sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "starts",
        F.crc32("input_ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )
