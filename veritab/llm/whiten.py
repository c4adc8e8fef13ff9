"""Whitening of vectors on their leading principal components.

Method: FEAST. Counts of eigenvalues below a point (the inertia of the shifted covariance, by Sylvester's
law) cut the wanted end of the spectrum into intervals. Around each interval a contour is laid; a
quadrature of solves of the complex shifted covariance projects a block of vectors onto the eigenvectors
inside, Rayleigh-Ritz extracts them, and the inertia count says whether any is missing (Polizzi, "Density-
matrix-based algorithm for solving eigenvalue problems", 2009).

Vectors are summed where they lie: tasks send sums of whole numbers only, which do not depend on how rows
are dealt, so the covariance is exact before it is rounded once. Intervals are solved in parallel. What the
driver holds is of the size of one covariance, dimension squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the contract: x = floor(64 c) + 1000000.
SCALE, OFFSET = 64.0, 1_000_000
#: Entries whose step lies beyond this count as non-finite.
LARGEST = float(1 << 60)
#: Bits of a number that take part in one exact product of doubles, and rows that are added up at once.
LIMB, BLOCK_ROWS = 20, 1 << 12
#: Eigenvalues that an interval should hold at most, points on half a contour, and passes at most.
INTERVAL, POINTS, PASSES = 12, 8, 30
TOLERANCE = 1e-13
#: Vectors handled at once are as many as have this many entries.
ENTRIES = 1 << 21


def steps(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column that are usable, and their whole numbers x - OFFSET, one row each.

    Usable vectors are not null or empty, hold no null, non-finite or far too large entry and, if given, have
    ``dimension`` entries.
    """
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    fits = sizes == dimension if dimension else sizes > 0
    # Flattening leaves null lists out, so sizes of the others add up to its length.
    values = column.flatten().cast(pa.float64())
    plain = values.to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(SCALE * plain)
        good = np.abs(whole) <= LARGEST  # false for NaN, which a null has become
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~good)])
    fits &= bad[ends] == bad[ends - sizes]
    rows = np.flatnonzero(fits)
    if dimension is None:
        return rows, sizes[rows]
    places = (ends - sizes)[rows, None] + np.arange(dimension)
    return rows, whole[places].astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the usable rows and their whole numbers."""
    size = max(1, ENTRIES // max(1, dimension))
    for batch in batches:
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            rows, x = steps(part.column(part.num_columns - 1), dimension)
            if len(rows):
                yield part, rows, x


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """Signed parts of LIMB bits as doubles, lowest first; together they make d."""
    out, sign, rest = [], np.sign(d), np.abs(d)
    while not out or rest.any():
        out.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
        rest = rest >> LIMB
    return out


def _dimension(vectors: DataFrame) -> int:
    """The most frequent length of usable vectors, the smallest of equally frequent ones; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes = steps(batch.column(0))
            lengths, times = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(times, pa.int64())], ["length", "rows"])

    counted = vectors.mapInArrow(run, "length long, rows long").groupBy("length").agg(F.sum("rows").alias("rows"))
    first = counted.orderBy(F.desc("rows"), "length").first()
    return int(first["length"]) if first else 0


def _whole_sums(rows: DataFrame, *keys: str) -> list:
    return rows.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def exact_sums(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of usable vectors, and the sum of x per dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dimension, 0
        for _, rows, x in _batches(batches, dimension):
            n += len(rows)
            for k, part in enumerate(limbs(x)):
                total = [a + (int(b) << (LIMB * k)) for a, b in zip(total, part.sum(axis=0))]
        values = [str(v) for v in [n, *total]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimension)), pa.array(values)], ["place", "value"])

    found = {r["place"]: int(r["value"]) for r in _whole_sums(vectors.mapInArrow(run, "place long, value string"), "place")}
    n = found[-1]
    return n, [found[i] + n * OFFSET for i in range(dimension)]


def exact_covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of x, divisor n, rounded once.

    Vectors are centred on the whole number next to the mean before they are multiplied; what is left of the mean
    is taken off exactly.
    """
    dimension = len(sums)
    centre = np.array([s // n for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension), object)
        for _, _, x in _batches(batches, dimension):
            d = x + (OFFSET - centre)
            for at in range(0, len(d), BLOCK_ROWS):
                parts = limbs(d[at : at + BLOCK_ROWS])
                for i, a in enumerate(parts):
                    for j, b in enumerate(parts):
                        # Products of LIMB bits, added up over BLOCK_ROWS rows, are exact in doubles.
                        product = (a.T @ b).astype(np.int64).astype(object)
                        total += product << (LIMB * (i + j)) if i + j else product
        row, column = np.triu_indices(dimension)
        values = pa.array([str(v) for v in total[row, column]])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), values], ["row", "column", "value"])

    found = _whole_sums(vectors.mapInArrow(run, "row long, column long, value string"), "row", "column")
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((dimension, dimension))
    for r in found:
        i, j = r["row"], r["column"]
        out[i, j] = out[j, i] = (n * int(r["value"]) - rest[i] * rest[j]) / (n * n)  # whole numbers, one rounding
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if not size:
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = 2 * (p - (v @ p) * v)
        below -= np.outer(w, v) + np.outer(v, w)
        a[k + 1, k] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, point: float) -> int:
    """Number of eigenvalues less than ``point``: negative pivots of the shifted matrix."""
    count, pivot = 0, 1.0
    tiny = np.finfo(float).tiny
    for i, a in enumerate(diagonal):
        pivot = a - point - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, most: int = INTERVAL) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues inside) of intervals that hold the ``wanted`` largest and all ties of the last."""
    size = len(diagonal)
    reach = np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = max(abs(low), abs(high)) * 1e-9 + np.finfo(float).tiny
    low, high = low - margin, high + margin
    finest = margin * 1e-5
    # The lowest point above which the wanted ones lie.
    a, b = low, high
    while b - a > finest:
        middle = (a + b) / 2
        if size - below(diagonal, off, middle) >= wanted:
            a = middle
        else:
            b = middle
    out, open_parts = [], [(a - finest, high, size - below(diagonal, off, a - finest))]
    while open_parts:
        low, high, inside = open_parts.pop()
        if inside <= most or high - low <= 4 * finest:
            if inside:
                out.append((low, high, inside))
            continue
        middle = (low + high) / 2
        above = size - below(diagonal, off, middle) - (size - below(diagonal, off, high))
        open_parts += [(low, middle, inside - above), (middle, high, above)]
    return sorted(out, reverse=True)


def contour_vectors(a: np.ndarray, low: float, high: float, inside: int, seed: int) -> np.ndarray:
    """Orthonormal eigenvectors of all ``inside`` eigenvalues between ``low`` and ``high``."""
    size = len(a)
    scale = float(np.abs(a).max()) or 1.0
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-12 * scale)
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = -np.pi / 2 * (points - 1)
    width = min(size, inside + inside // 2 + 4)
    block, settled = np.random.default_rng(seed).normal(size=(size, width)), False
    for _ in range(PASSES):
        projected = np.zeros_like(block)
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            projected += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(size) - a, block)).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ small
        edge = 1e-12 * scale
        within = (values >= low - edge) & (values <= high + edge)
        left = np.linalg.norm(a @ vectors - vectors * values, axis=0)
        # The inertia says how many there are; spurious values have large residuals.
        found = np.flatnonzero(within & (left <= TOLERANCE * size * scale))
        if len(found) >= inside and settled:
            outside = np.maximum(low - values[found], values[found] - high)
            return vectors[:, found[np.argsort(np.maximum(outside, 0), kind="stable")[:inside]]]
        block, settled = vectors, len(found) >= inside  # one pass more takes the error down to rounding
    raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, {len(found)} were found")


def leading_components(spark, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    diagonal, off = tridiagonal(covariance)
    parts = intervals(diagonal, off, min(most, len(covariance)))
    held = spark.sparkContext.broadcast(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, low, high, inside in zip(*(batch.column(i).to_pylist() for i in range(4))):
                vectors = contour_vectors(held.value, low, high, inside, number)
                columns = [pa.array([number]), pa.array([vectors.T.ravel()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["number", "vectors"])

    rows = [(i, float(low), float(high), int(inside)) for i, (low, high, inside) in enumerate(parts)]
    frame = spark.createDataFrame(rows, "number long, low double, high double, inside long").repartition(len(rows), "number")
    solved = sorted(frame.mapInArrow(run, "number long, vectors array<double>").collect())
    whole = np.concatenate([np.array(r["vectors"]).reshape(-1, len(covariance)) for r in solved]).T
    # Vectors of neighbouring intervals are made orthogonal, and extracted once more together.
    basis, _ = np.linalg.qr(whole)
    values, small = np.linalg.eigh(basis.T @ covariance @ basis)
    held.destroy()
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], basis @ small[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: counts and sums are whole numbers, components stand in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n with one rounding."""
        centre = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, centre)])
        return (x + (OFFSET - centre)).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2 per row; None where it passes 64 bits."""
        rest = [s - self.n * (s // self.n) for s in self.sums]
        d = x + (OFFSET - np.array([s // self.n for s in self.sums], np.int64))
        largest = max(int(np.abs(d).max(initial=0)), self.n)
        if largest * largest * self.dimension >= 1 << 63:
            d, rest = d.astype(object), np.array(rest, object)
        else:
            rest = np.array(rest, np.int64)
        # (n d - r)**2 in whole numbers of any size, but one per row only.
        squares, mixed = (d * d).sum(axis=1).tolist(), (d * rest).sum(axis=1).tolist()
        last = sum(int(r) ** 2 for r in rest)
        sums = [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(squares, mixed)]
        return [v if v < 1 << 63 else None for v in sums]


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int = 32) -> Whitening | None:
    """Fit on all usable vectors; None if there are none.

    Vectors of another length than the most frequent one are not usable. Components whose eigenvalue is nought up to
    rounding are left out, so there are fewer than ``most`` where the vectors do not spread as far. Repeated vectors count
    each time.
    """
    column = vectors.select(F.col(vector_col).cast("array<double>"))
    dimension = _dimension(column)
    if not dimension:
        return None
    n, sums = exact_sums(column, dimension)
    covariance = exact_covariance(column, n, sums)
    trace = float(np.trace(covariance))
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    values, components = leading_components(vectors.sparkSession, covariance, most)
    kept = values > dimension * np.finfo(float).eps * trace
    return Whitening(n, sums, values[kept], components[:, kept], trace)


def transform(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", name: str = "whitened") -> DataFrame:
    """The usable rows of ``vectors`` with two more columns: ``name`` (array) and ``deviation``.

    Columns of these names are replaced. Without a model there are no rows.
    """
    kept = [c for c in vectors.columns if c not in (name, "deviation")]
    out = vectors.select(*kept, F.col(vector_col).cast("array<double>").alias("_vector"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("_vector").schema.fields)
    schema += f", `{name}` array<double>, deviation long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        for part, rows, x in _batches(batches, model.dimension):
            own = part.take(pa.array(rows))
            flat, width = model.whitened(x), len(model.values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(flat.ravel()))
            columns = [*own.columns[:-1], lists, pa.array(model.deviations(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*own.schema.names[:-1], name, "deviation"])

    return out.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity."""
    width = len(model.values)
    if not width:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The whitened vectors are centred already; what rounding leaves of their mean is taken off at the end.
        product, total = np.zeros((width, width)), np.zeros(width)
        for _, _, x in _batches(batches, model.dimension):
            w = model.whitened(x)
            product += w.T @ w
            total += w.sum(axis=0)
        row, column = np.triu_indices(width)
        rows = np.concatenate([row, np.full(width, -1)])
        columns = np.concatenate([column, np.arange(width)])
        values = np.concatenate([product[row, column], total])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(columns), pa.array(values)], ["row", "column", "value"])

    sums = vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(run, "row long, column long, value double")
    found = {(r["row"], r["column"]): r["value"] for r in sums.groupBy("row", "column").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([found[-1, i] for i in range(width)]) / model.n
    return max(abs(found[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in range(width) for j in range(i, width))


def components_of(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", most: int = 32) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Null, empty, non-finite and otherwise unusable vectors have no rows, as have all if the usable ones are equal. Repeated
    rows and null ids stay as they are. Other columns are not read.
    """
    model = fit(vectors, vector_col, most)
    error = identity_error(vectors, model, vector_col) if model else 0.0
    rows = transform(vectors.select(F.col(id_col), F.col(vector_col).alias("_own")), model, "_own", "_whitened")
    shares = [float(v / model.trace) for v in model.values] if model else []
    explained: Column = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("_at"))
    return rows.select(id_col, "deviation", F.posexplode("_whitened").alias("_at", "whitened")).select(
        id_col, (F.col("_at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
