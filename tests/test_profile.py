import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions.text import misspell
from veritab.operators import features, profile, quantiles, rank
from veritab.spec import TableSpec

P1 = [(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0), (5, None)]
P1_SPEC = TableSpec(name="p1", id_col="id", columns={"x": "numeric"})


def test_hand_worked_profile(spark):
    df = spark.createDataFrame(P1, "id bigint, x double")
    stats = profile.column_stats(df, ["x"])["x"]
    assert (stats.median, stats.mad) == (2.0, 0.5)
    assert stats.spread == pytest.approx(0.7413)
    cells = {r["id"]: r for r in features.column_features(df, P1_SPEC).collect()}
    assert cells[4]["robust_z"] == pytest.approx(2.697963, abs=1e-6)
    assert cells[5]["robust_z"] == 0 and cells[5]["value_freq"] == 0 and cells[5]["is_null"] == 1
    assert cells[2]["value_freq"] == 0.5 and cells[4]["ratio_to_median"] == 2
    assert profile.distance_scales(df, ["x"])["x"].width == pytest.approx(1.095445, abs=1e-6)
    assert profile.distance_scales(df, ["x"], flat_as_std=False)["x"].width == 1.0


@pytest.mark.parametrize(
    "value, expected",
    [
        ("male", (1, 0, 0, 0)), ("mael", (0, 2, 0, 0)), (" male", (0, 1, 1, 0)),
        ("male\t", (0, 1, 1, 0)), ("male ", (0, 1, 1, 0)), ("MALE", (0, 4, 0, 1)), (None, (0, 0, 0, 0)),
    ],
)
def test_text_features(spark, value, expected):
    spec = TableSpec(name="t", id_col="id", columns={"s": "category"}, allowed={"s": ("male", "female")})
    df = spark.createDataFrame([(1, value)], "id bigint, s string")
    row = features.column_features(df, spec).first()
    names = ("in_allowed_set", "edit_dist_to_allowed", "has_whitespace", "case_mismatch")
    assert tuple(row[n] for n in names) == expected


def test_misspellings_are_never_valid(spark):
    allowed = ["F", "male", "female", "amle"]
    df = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, allowed[:3])), (F.col("id") % 3 + 1).cast("int")).alias("v"))
    out = df.selectExpr("v", f"{misspell('v', allowed, 'md5(cast(id as string))')} AS typo").collect()
    assert all(r["typo"] and r["typo"] != r["v"] and r["typo"] not in allowed for r in out)
    seen = {r["typo"] for r in out if r["v"] == "male"}
    assert seen == {"mlae", "mael", "ale", "mle", "mae", "mal", "Male", "MALE", "male ", " male"}
    assert {r["typo"] for r in out if r["v"] == "F"} == {"F ", " F"}


@pytest.mark.parametrize("limit", [5, 200, 10_000])
def test_quantiles_match_linear_interpolation(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "FETCH", limit)
    rng = random.Random(7)
    tied = [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(3000)]
    spread = [rng.lognormvariate(0, 3) for _ in range(3000)]
    gaps = [None if i % 4 else float(i) for i in range(3000)]
    df = spark.createDataFrame(list(zip(tied, spread, gaps)), "a double, b double, c double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.quantiles(df, {n: F.col(n) for n in "abc"}, probabilities)
    for name, data in zip("abc", (tied, spread, [g for g in gaps if g is not None])):
        assert found[name] == pytest.approx(np.quantile(data, probabilities), rel=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.quantiles(df, {"a": F.col("a")}, [0.5]) == {"a": [None]}


def test_ordered_index_is_the_plain_rank(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("k"))
    indexed, size = rank.ordered_index(df, ["k", "id"], "at")
    plain = df.selectExpr("id", "row_number() OVER (ORDER BY k, id) - 1 AS want")
    assert size == 5000
    assert indexed.join(plain, "id").filter("at != want").count() == 0


def test_identical_rows_get_distinct_numbers(spark):
    df = spark.range(3000).select(F.lit(1).alias("same"))
    indexed, size = rank.ordered_index(df, ["same"], "at")
    assert indexed.agg(F.countDistinct("at"), F.min("at"), F.max("at")).first()[:] == (3000, 0, 2999)


def test_running_total(spark):
    df = spark.range(1, 2000).selectExpr("id * 1.5 AS s", "id AS n")
    out = rank.running_total(df, "s", "n", "below")
    assert out.filter("below != n * (n - 1) / 2").count() == 0


def test_summary_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None)], "x double, s string")
    row = profile.summary(df, ["x"]).first()
    assert (row["count"], row["mean"], row["q50"], row["max"]) == (3, 2.3, 2.0, 4.0)
    assert profile.column_modes(df, ["s"]) == {"s": "a"}


def test_indexed_label_distances_equal_all_comparisons(spark):
    import random

    from veritab.operators import labels

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcé😀", k=rng.randint(1, 7)))
    allowed = {"x": [word() for _ in range(80)] + ["q" * 60], "y": ["label"]}
    keys = [word() for _ in range(300)] + ["", None, "q" * 59, "zzzzzzzzzzzz", "bale", "abc" * 30]
    frame = spark.createDataFrame([(c, k) for c in ("x", "y", "z") for k in keys], "column string, key string")
    got = {(r["column"], r["key"]): r["edit_distance"] for r in labels.label_distances(frame, allowed).collect()}
    want = {(c, k): min((edits(k, a) for a in allowed.get(c, [])), default=0) if k else 0 for c in ("x", "y", "z") for k in keys}
    assert got == want


def test_label_distances_of_a_table_of_labels(spark):
    """Labels stay in a table, and their patterns are exchanged, not sent whole to the driver and every task."""
    from veritab.operators import labels

    known = spark.createDataFrame([("x", f"label-{i:05d}") for i in range(0, 4000, 10)] + [("x", None), ("x", "label-00000")], "column string, label string")
    keys = [("label-00010", 0), ("label-0001", 1), ("label-01230", 0), ("labl-0123", 2), ("12label-00010", 2), ("Label-00011", 2), ("elabl-00010", 2), ("", 0), ("lab", 8)]
    found = labels.label_distances(spark.createDataFrame([("x", k) for k, _ in keys], "column string, key string"), known)
    assert {r["key"]: r["edit_distance"] for r in found.collect()} == dict(keys)
    some = known.limit(9).withColumnRenamed("label", "key")
    plan = labels._within(some, known, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
