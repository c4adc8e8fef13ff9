import numpy as np
import pytest

from veritab.llm import whiten


def plain(rows, dimension, most=32):
    """(id, deviation, whitened up to the sign, explained) by a full eigendecomposition."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dimension and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good], object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    return [i for i, _ in good], deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def made(n, dimension, seed):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in r.normal(size=dimension) * np.linspace(1, 4, dimension) + 7]) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39),
    (905, [1.0, 2.0]), (906, [1e300] * 40), (None, [3.0] * 40), (907, [3.0] * 40), (907, [3.0] * 40),
]


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_equals_a_full_decomposition(spark, kind):
    rows = made(300, 40, 1) + ODD
    if kind == "array<float>":
        rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v if c is None or abs(c) < 1e300 or not np.isfinite(c)]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding {kind}, whitened int, _at int").repartition(5)
    found = whiten.components_of(frame).collect()
    usable = [(i, v) for i, v in rows if i != 906]
    ids, deviation, want, explained = plain(usable, 40)
    assert len(found) == len(ids) * 32 and {r["n"] for r in found} == {len(ids)}
    first = [k for k, i in enumerate(ids) if i is not None and i < 900]
    by = {(r["vec_id"], r["component"]): r for r in found}
    got = np.array([[by[ids[k], c]["whitened"] for c in range(1, 33)] for k in first])
    sign = np.sign((got * want[first]).sum(axis=0))
    assert np.abs(got * sign - want[first]).max() < 1e-9
    assert all(by[ids[k], 1]["deviation"] == deviation[k] for k in first)
    assert np.allclose([by[ids[0], c]["explained"] for c in range(1, 33)], explained, rtol=1e-10)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9
    assert sum(r["vec_id"] is None for r in found) == 32 and sum(r["vec_id"] == 907 for r in found) == 64


def test_sums_do_not_depend_on_the_tasks(spark):
    frame = spark.createDataFrame(made(200, 6, 2), "vec_id long, embedding array<double>")
    models = [whiten.fit(frame.repartition(k)) for k in (1, 7)]
    assert models[0].sums == models[1].sums and (models[0].values == models[1].values).all()


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [float(i) * 2.0**40, -float(i % 7) * 2.0**33, 5.0 * i]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, sums = whiten.exact_sums(frame.select("embedding"), 3)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    assert n == 50 and sums == list(x.sum(axis=0))
    exact = [[sum((n * int(a) - int(s)) * (n * int(b) - int(t)) for a, b in zip(x[:, i], x[:, j])) / n**3 for j, t in enumerate(sums)] for i, s in enumerate(sums)]
    assert np.allclose(whiten.exact_covariance(frame.select("embedding"), n, sums), np.array(exact, float), rtol=1e-15)
    got = {r["vec_id"]: r["deviation"] for r in whiten.transform(frame, whiten.fit(frame)).collect()}
    want = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_few_dimensions_equal_vectors_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], schema)
    assert {r["component"] for r in whiten.components_of(flat).collect()} == {1}
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)
    assert whiten.components_of(equal).count() == 0 and whiten.transform(equal, whiten.fit(equal)).count() == 4
    for rows in ([], [(1, None), (2, [])]):
        assert whiten.components_of(spark.createDataFrame(rows, schema)).collect() == []


def test_inertia_and_contours():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.normal(size=(30, 30)))
    values = np.sort(np.concatenate([np.full(7, 2.0), np.full(3, 2.0 + 1e-13), r.random(20)]))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    diagonal, off = whiten.tridiagonal(a)
    for point in (-1.0, 0.2, 0.5, 1.5, 3.0):
        assert whiten.below(diagonal, off, point) == (values < point).sum()
    parts = whiten.intervals(diagonal, off, 14, most=4)
    assert sum(n for _, _, n in parts) == 14
    vectors = np.concatenate([whiten.contour_vectors(a, low, high, n, 1) for low, high, n in parts], axis=1)
    assert np.abs(a @ vectors - vectors * np.diag(vectors.T @ a @ vectors)).max() < 1e-12
    assert np.allclose(np.sort(np.diag(vectors.T @ a @ vectors)), values[-14:])
