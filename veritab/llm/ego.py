"""Near-duplicate vectors by cosine: an epsilon grid order join.

Method: unit vectors are turned to their principal axes and sorted by the cells of a grid of width
epsilon on the leading ones, epsilon being the Euclidean distance that the cosine threshold stands
for. The sorted sequence is cut into intervals. Pairs of intervals are joined recursively, from
wide ones to narrow ones; a pair whose boxes lie further apart than epsilon is skipped, since none
of its vectors can link. Equal vectors are one vector with a weight.

The last levels of the recursion run on arrays within a task. Filters use single precision with
a margin; whether two vectors link is decided on their cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm.components import Forest, components
from veritab.llm.spread import lookup_by_size
from veritab.session import materialize

THRESHOLD = 0.95
#: Leading axes that order the sequence, and those that bound the boxes.
ORDER_AXES, BOX_AXES = 6, 16
#: Vectors in an interval that travels as one row, and in one that is compared at once.
INTERVAL, BLOCK = 4096, 256
#: Intervals below one of the next level.
FAN = 16
MARGIN = 1e-4


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, length)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # keeps the squares in range
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def keys(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, vector, length): key is null where a vector can link with nothing."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector_col, lambda x: x != 0)
    good = F.coalesce(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite & some, F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(good, F.col(vector_col).cast("array<float>")).alias("vector"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # no -0.0
            there = column.is_valid().to_numpy(zero_copy_only=False)
            key = [
                hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if v else None
                for a, b, v in zip(offsets, offsets[1:], there)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(key, pa.binary()), column], ["id", "key", "vector"]
            )

    return rows.mapInArrow(run, "id long, key binary, vector array<float>")


def principal_axes(vectors: DataFrame, length: int) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, the strongest first.

    Each task adds up its own moments; the driver gets length**2 sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("vector"), length))
                total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length * length)), pa.array(total.ravel())], ["at", "part"])

    sums = vectors.select("vector").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("total"))
    moments = np.zeros(length * length)
    for row in sums.collect():
        moments[row["at"]] = row["total"]
    moments = moments.reshape(length, length)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def sequence(vectors: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """The vectors in epsilon grid order: (id, weight, vector, box axes, interval)."""
    length, order = len(axes), min(ORDER_AXES, len(axes))
    shown = min(BOX_AXES, length)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _unit(_matrix(batch.column("vector"), length)) @ axes[:, :shown] if batch.num_rows else np.zeros((0, shown))
            cells = np.floor(place[:, :order] / epsilon).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, place.size + 1, shown), pa.int32()), pa.array(place.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "weight", "vector")), lists, *(pa.array(cells[:, i]) for i in range(order))],
                ["id", "weight", "vector", "place", *cell_names],
            )

    cell_names = [f"c{i}" for i in range(order)]
    schema = "id long, weight long, vector array<float>, place array<double>, " + ", ".join(f"{c} int" for c in cell_names)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (
        vectors.mapInArrow(turn, schema).repartitionByRange(parts, *cell_names, "id").sortWithinPartitions(*cell_names, "id")
    )
    # The row number within a part is fixed by writing it.
    numbered = materialize(
        sorted_rows.select("id", "weight", "vector", "place", F.monotonically_increasing_id().alias("at"))
    )
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per part
    before, starts = 0, []
    for row in sizes:
        starts.append((row["part"], before))
        before += row["count"]
    offsets = numbered.sparkSession.createDataFrame(starts, "part long, before long")
    return (
        numbered.withColumn("part", part.cast("long"))
        .join(F.broadcast(offsets), "part")
        .withColumn("position", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .select("id", "weight", "vector", "place", "position", F.floor(F.col("position") / INTERVAL).cast("long").alias("interval"))
    )


def near_intervals(rows: DataFrame, count: int, axes: int, epsilon: float) -> DataFrame:
    """Pairs (i, j), i <= j, of intervals whose boxes are no further apart than epsilon.

    The recursion starts with one interval of everything and opens pairs level by level.
    """
    leaf = rows.select("interval", F.posexplode("place").alias("axis", "x")).groupBy("interval", "axis").agg(
        F.min("x").alias("low"), F.max("x").alias("high")
    )
    leaf = materialize(leaf)
    levels = 0
    while FAN**levels < count:
        levels += 1

    def boxes(level: int) -> DataFrame:
        node = F.floor(F.col("interval") / FAN**level).cast("long").alias("node")
        bounds = leaf.groupBy(node, "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return bounds.groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("box")
        ).withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))

    pairs = rows.sparkSession.createDataFrame([(0, 0)], "i long, j long")
    for level in range(levels - 1, -1, -1):
        nodes = materialize(boxes(level))
        a = nodes.select(F.col("parent").alias("i"), F.col("node").alias("a"), F.col("box").alias("box_a"))
        b = nodes.select(F.col("parent").alias("j"), F.col("node").alias("b"), F.col("box").alias("box_b"))

        def gap(x, y):
            apart = F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0))
            return apart * apart

        squares = F.zip_with("box_a", "box_b", gap)
        distance = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
        pairs = materialize(
            pairs.join(a, "i").join(b, "j").filter((F.col("a") <= F.col("b")) & (distance <= epsilon**2 + MARGIN))
            .select(F.col("a").alias("i"), F.col("b").alias("j"))
        )
    return pairs


def join_blocks(x: np.ndarray, y: np.ndarray, place_x: np.ndarray, place_y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of x and y (unit vectors) that link; pairs of blocks that are far apart are skipped."""
    limit = 2 - 2 * threshold + MARGIN
    for a in range(0, len(x), BLOCK):
        xa, pa_ = x[a : a + BLOCK], place_x[a : a + BLOCK]
        low, high = pa_.min(axis=0), pa_.max(axis=0)
        for b in range(a if same else 0, len(y), BLOCK):
            yb, pb = y[b : b + BLOCK], place_y[b : b + BLOCK]
            gap = np.maximum(0, np.maximum(low - pb.max(axis=0), pb.min(axis=0) - high))
            if (gap * gap).sum() > limit:
                continue
            # Distance on the leading axes alone bounds the whole distance from below.
            square = (pa_ * pa_).sum(axis=1)[:, None] + (pb * pb).sum(axis=1)[None, :] - 2 * (pa_ @ pb.T)
            i, j = np.nonzero(square <= limit)
            if len(i) > xa.shape[0] * yb.shape[0] // 50:
                i, j = np.nonzero(xa @ yb.T >= threshold - MARGIN)
            good = np.einsum("ij,ij->i", xa[i], yb[j]) >= threshold
            i, j = i[good] + a, j[good] + b
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def links(rows: DataFrame, pairs: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, links): per interval pair, links of vector ``a`` (b null), or an edge of its forest."""
    length, shown = len(axes), min(BOX_AXES, len(axes))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        return pa.table({
            "interval": table["interval"][:1],
            "ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "weights": pa.array([table["weight"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([_matrix(table["vector"].combine_chunks(), length).tobytes()], pa.binary()),
        })

    packed = materialize(
        rows.select("interval", "position", "id", "weight", "vector").groupBy("interval")
        .applyInArrow(gather, "interval long, ids binary, weights binary, vectors binary")
    )

    def side(name: str) -> DataFrame:
        return packed.select(F.col("interval").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("ids", "weights", "vectors")])

    def opened(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"ids_{name}"], np.int64)
        unit = _unit(np.frombuffer(row[f"vectors_{name}"], np.float32).reshape(-1, length))
        return ids, np.frombuffer(row[f"weights_{name}"], np.int64), unit, (unit @ axes[:, :shown]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                same = row["i"] == row["j"]
                ids, weights, x, place = opened(row, "i")
                if same:
                    ids_y, weights_y, y, place_y, shift = ids, weights, x, place, 0
                else:
                    ids_y, weights_y, y, place_y = opened(row, "j")
                    shift = len(ids)
                forest = Forest(shift + len(ids_y))
                count = np.zeros(shift + len(ids_y), np.int64)
                for i, j in join_blocks(x, y, place, place_y, same, threshold):
                    np.add.at(count, i, weights_y[j])
                    np.add.at(count, j + shift, weights[i])
                    forest.join(i, j + shift)
                names = ids if same else np.concatenate([ids, ids_y])
                seen = np.flatnonzero(count)
                root = forest.roots()
                low = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([names[seen], names[low]])),
                        pa.concat_arrays([pa.nulls(len(seen), pa.int64()), pa.array(names[root[low]])]),
                        pa.concat_arrays([pa.array(count[seen]), pa.nulls(len(low), pa.int64())]),
                    ],
                    ["a", "b", "links"],
                )

    both = pairs.join(side("i"), "i").join(side("j"), "j")
    return both.mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, and
    neither do vectors of different lengths. Repeated rows are vectors of their own that link with
    each other. A row without an id takes part but is never the smallest id; kept is then false.
    """
    spark = vectors.sparkSession
    epsilon = float(np.sqrt(2 - 2 * threshold))
    keyed = materialize(keys(vectors, id_col, vector_col))
    # Within a group, rows are named by their key's smallest row number, so null ids do no harm.
    groups = materialize(
        keyed.filter("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("weight"), F.min("id").alias("least_id"), F.first("vector").alias("vector"),
        ).withColumn("id", F.monotonically_increasing_id())
    )
    total = keyed.filter("key IS NOT NULL").count()
    found = None
    for row in groups.select(F.size("vector").alias("length")).distinct().collect():
        some = groups.filter(F.size("vector") == row["length"]).select("id", "weight", "vector")
        axes = principal_axes(some, row["length"])
        rows = materialize(sequence(some, axes, epsilon))
        count = rows.agg(F.max("interval")).first()[0] + 1
        part = links(rows, near_intervals(rows, count, min(BOX_AXES, row["length"]), epsilon), axes, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = materialize(found)
    linked = found.filter("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    member = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = groups.select("id", "key", "weight", "least_id").join(member, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    result = materialize(
        named.join(smallest, "component").join(linked, "id", "left").select(
            "key", "weight", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
        )
    )
    alone = keyed.filter("key IS NULL").select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return lookup_by_size(keyed.filter("key IS NOT NULL").select("id", "key"), result, "key", "weight", total).select(
        F.col("id").alias(id_col), "n_links", "component_id"
    ).unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
