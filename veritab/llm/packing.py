"""Packing of documents into as few fixed-size sequences as it can.

Method: dominance reduction, then best fit. What fits together depends on lengths alone, so the
plan is made over the counts per length, at most ``limit`` of them however many documents there
are. A small set that provably dominates every other set with its longest piece is fixed for as
many bins as its pieces allow, the instance shrinks, and the rest is packed best fit decreasing,
again for whole counts at a time. Spark then deals each piece its place: the rank of a piece among
those of its length selects a row of the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veritab.llm.bpe import encoder, texts_of
from veritab.session import materialize

LIMIT = 1024
END = 2
#: A bin type: how many such bins, and (length, how many) of its pieces.
Pattern = tuple[int, list[tuple[int, int]]]


def reduce_by_dominance(counts: np.ndarray, limit: int) -> list[Pattern]:
    """Fix dominating bins and take their pieces out of ``counts`` (by length, changed in place).

    For the longest piece ``j`` and the longest piece ``i`` that fits beside it:

    * nothing fits beside ``j``: it stays alone;
    * ``j + i`` fill the bin: whatever else may lie beside ``j`` fits in the place of ``i``;
    * no two pieces fit beside ``j``: ``i`` is at least what any other bin has there;
    * at most two fit: ``{j, i}`` if no pair is longer than ``i``; ``{j, i, b}``, ``b`` the longest
      that fits too, if no pair that is longer than ``i`` has both pieces longer than ``b``.
    """
    fixed: list[Pattern] = []

    def there(lengths: list[int]) -> bool:
        return all(counts[x] >= lengths.count(x) for x in lengths)

    def longest(room: int, besides: list[int]) -> int:
        """The longest piece of at most ``room`` when ``besides`` are used; 0 if there is none."""
        for x in range(min(room, limit), 0, -1):
            if counts[x] > besides.count(x):
                return x
        return 0

    def smallest(besides: list[int], n: int) -> list[int]:
        out: list[int] = []
        for x in np.flatnonzero(counts):
            free = int(counts[x]) - besides.count(int(x))
            out += [int(x)] * min(free, n - len(out))
            if len(out) == n:
                break
        return out

    def dominating(j: int) -> list[int] | None:
        i = longest(limit - j, [j])
        if not i:
            return [j]
        if i + j == limit:
            return [j, i]
        few = smallest([j], 3)
        if len(few) < 2 or j + few[0] + few[1] > limit:
            return [j, i]
        if len(few) == 3 and j + sum(few) <= limit:
            return None
        room = limit - j
        pairs = [
            (x, y)
            for x in range(room, 0, -1)
            if counts[x] and (y := longest(min(x, room - x), [j, x])) and there([j, x, y])
        ]
        if all(x + y <= i for x, y in pairs):
            return [j, i]
        b = longest(room - i, [j, i])
        return [j, i, b] if b and all(min(x, y) <= b or x + y <= i for x, y in pairs) else None

    changed = True
    while changed:
        changed = False
        for j in range(limit, 0, -1):
            while counts[j] and (found := dominating(j)) is not None:
                kinds = sorted(set(found), reverse=True)
                # The same set dominates as long as its pieces last: fewer others can only fit less.
                times = min(int(counts[x]) // found.count(x) for x in kinds)
                for x in kinds:
                    counts[x] -= times * found.count(x)
                fixed.append((times, [(x, found.count(x)) for x in kinds]))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, limit: int) -> list[Pattern]:
    """Best fit decreasing over counts: bins with the same pieces are handled together."""
    by_room: dict[int, list[Pattern]] = {}

    def put(room: int, times: int, pieces: list[tuple[int, int]]) -> None:
        if times:
            by_room.setdefault(room, []).append((times, pieces))

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, limit) if by_room.get(r)), None)
            if room is None:
                each = limit // length
                put(limit - each * length, left // each, [(length, each)])
                put(limit - (left % each) * length, int(left % each > 0), [(length, left % each)])
                break
            times, pieces = by_room[room].pop()
            each = room // length
            whole = min(times, left // each)
            part = left - whole * each if whole < times else 0  # the last bin takes what is left
            put(room - each * length, whole, [*pieces, (length, each)])
            put(room - part * length, int(part > 0), [*pieces, (length, part)])
            put(room, times - whole - int(part > 0), pieces)
            left -= whole * each + part
    return [pattern for patterns in by_room.values() for pattern in patterns]


def plan_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, pieces per sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pieces in patterns:
        offset = 0
        for length, each in pieces:
            first = used.get(length, 0)
            used[length] = first + times * each
            rows.append((length, first, used[length], sequence, each, offset))
            offset += length * each
        sequence += times
    return rows


def pieces(documents: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32.

    A null text is empty and gives the end id alone. A document of over ``limit`` ids is cut into
    pieces of ``limit``; its first piece may be shorter.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, bounds in encoder(path).encode(texts_of(batch, text_col)):
                ids = np.insert(ids, bounds[1:], np.uint32(end)).astype("<u4")
                first = bounds[:-1] + np.arange(b - a)
                size = np.diff(bounds) + 1
                many = -(-size // limit)
                document = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(document)) - np.repeat(np.cumsum(many) - many, many)
                short = (size - (many - 1) * limit)[document]
                start = np.where(piece == 0, 0, short + (piece - 1) * limit)
                length = np.where(piece == 0, short, limit)
                data = memoryview(ids.tobytes())
                at = 4 * (first[document] + start)
                crc = [zlib.crc32(data[x : x + y]) for x, y in zip(at.tolist(), (4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col)[a:b].take(pa.array(document)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    return documents.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(documents: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` with sequence_id and offset; an empty table gives no rows.

    Repeated rows are packed each on their own. The driver holds one count per length and the plan
    (both bounded by ``limit``, not by the data). Ranks are taken within buckets of a length, at
    most a quarter of a task's share each, so one common length doesn't meet in one task.
    """
    spark = documents.sparkSession
    cut = materialize(pieces(documents, path, limit, end, id_col, text_col))
    counts = np.zeros(limit + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    share = max(1, int(counts.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets = spark.createDataFrame(
        [(i, int(n) // share + 1) for i, n in enumerate(counts.tolist()) if n], "length long, buckets long"
    )
    rest = counts.copy()
    patterns = reduce_by_dominance(rest, limit)
    plan = spark.createDataFrame(
        plan_rows(patterns + best_fit(rest, limit)),
        "length long, first long, behind long, sequence long, each long, place long",
    )
    dealt = cut.join(F.broadcast(buckets), "length").withColumn(
        "bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), "buckets")
    )
    # Rows that agree in all of these are the same piece, so a task that runs again deals the same places.
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    at = F.col("rank") - F.col("first")
    p = F.broadcast(plan.withColumnRenamed("length", "plan_length"))
    return ranked.join(
        p, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind"))
    ).select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
