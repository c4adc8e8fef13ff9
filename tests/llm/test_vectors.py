import numpy as np
import pytest

from veritab.llm import ego
from veritab.llm.components import components


def plain(rows, threshold):
    """(n_links, component) of every row position by comparing all pairs."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for g, (_, v) in zip(good, rows)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(root(i))) for i in range(n)]


def made(n, length, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, length))
    rows = []
    for i in range(n):
        v = base[i % len(base)] if i % 3 else r.normal(size=length)
        if i % 5:
            v = v + r.normal(size=length) * r.choice([0.0, 0.1, 0.2, 0.3])
        rows.append((1000 - i, [float(np.float32(x)) for x in v * r.choice([1, 3])]))
    return rows


ODD = [(5001, None), (5002, []), (5003, [0.0] * 8), (5004, [float("nan")] + [1.0] * 7), (5005, [None] + [1.0] * 7), (5006, [float("inf")] * 8),
       (None, [1.0] * 8), (5007, [2.0] * 8), (5007, [2.0] * 8), (5008, [1.0, 2.0]), (5009, [2.0, 4.0])]


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ego, "INTERVAL", 32)
        monkeypatch.setattr(ego, "FAN", 2)
    rows = made(400, 8, 3) + ODD
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, links string")
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ego.near_duplicates(frame).collect()], key=repr)
    want = sorted([(i, n, c, i is not None and i == c) for i, n, c in plain(rows, 0.95)], key=repr)
    assert got == want
    assert sum(n for _, n, _, _ in want) > 300


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ego.near_duplicates(frame).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(500, i) for i in range(300, 400)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["id"]: r["component"] for r in components(frame).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 300 for i in [*range(300, 400), 500]} | {7: 7, 8: 7, 9: 7}
