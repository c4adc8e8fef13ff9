"""A blocked Bloom filter of bounded size, built by Spark and small enough for every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: At most 2**17 blocks of 512 bits: 8 MB for each worker, however long the list is.
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 40
BITS_PER_KEY = 8


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its eight bit places within the block."""
    block = (hashes & np.uint64(blocks - 1)).astype(np.int64)
    rest = hashes >> np.uint64(20)
    odd = (rest * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    turn = np.arange(1, BITS_PER_KEY + 1, dtype=np.uint64)
    return block, ((odd[:, None] * turn[None, :] + rest[:, None]) >> np.uint64(55)).astype(np.int64)


class BlockedBloom:
    """One block of 64 bytes per key: a look-up touches one cache line."""

    def __init__(self, words: np.ndarray):
        self.words = words  # blocks x 8, uint64

    @classmethod
    def of(cls, hashes: DataFrame) -> BlockedBloom:
        """Build from a frame with one long column ``hash``; tasks build blocks, the driver joins them."""
        count = hashes.count()
        blocks = min(MAX_BLOCKS, 1 << max(0, -(-count // KEYS_PER_BLOCK) - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(blocks * 8, np.uint64)
            for batch in batches:
                block, bit = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), blocks)
                at = block[:, None] * 8 + (bit >> 6)
                np.bitwise_or.at(words, at.ravel(), np.uint64(1) << (bit & 63).astype(np.uint64).ravel())
            used = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["at", "word"])

        parts = hashes.filter("hash IS NOT NULL").mapInArrow(run, "at long, word long")
        found = parts.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
        words = np.zeros(blocks * 8, np.uint64)
        words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
        return cls(words.reshape(-1, 8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, bit = _bits(hashes, len(self.words))
        word = self.words[block[:, None], bit >> 6]
        return ((word >> (bit & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
