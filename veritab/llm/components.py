"""Connected components of a graph too large for one machine.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every step hangs neighbours under the smallest one nearby until only stars are left.
Each round is written to the shared folder, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.session import few_tasks, materialize


class Forest:
    """Union-find over row numbers, with arrays; the smallest member is the root."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return above
            self.parent = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: hang larger roots under smaller ones until all pairs agree."""
        while len(a):
            root = self.roots()
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.parent, high, low)


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        forest.join(index[: len(a)], index[len(a) :])
        root = forest.roots()
        low = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(names[low]), pa.array(names[root[low]])], ["big", "small"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id (long, not null) of the edges (a, b): the smallest id it reaches."""
    clean = edges.filter("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
    state = materialize(clean.mapInArrow(_local_forest, "big long, small long").distinct())
    print_of = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small")), F.bit_xor(F.xxhash64("small", "big"))).first()
        if tuple(now) == print_of:
            return state.select(F.col("big").alias("id"), F.col("small").alias("component")).unionByName(
                state.select(F.col("small").alias("id"), F.col("small").alias("component")).distinct()
            )
        print_of, rows = tuple(now), 2 * now[0]
        both = state.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
            state.select(F.col("small").alias("u"), F.col("big").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u goes under the smallest one of u.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("big"), F.col("m").alias("small"))
        large = few_tasks(large, rows).mapInArrow(_local_forest, "big long, small long").distinct()
        large = materialize(few_tasks(large, rows))
        # Small star: the smaller neighbours of u, and u, go under the smallest of them.
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        near = large.join(least, "big")
        small = near.filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        state = small.unionByName(least.select("big", F.col("m").alias("small"))).distinct()
        state = materialize(few_tasks(state, rows))
