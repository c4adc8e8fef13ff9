"""Gaps, NaN, large numbers and repeated ids, as natural tables have them."""

import re

import pytest
from pyspark.sql import functions as F

from veritab.operators import clean, copies, iforest, inject, profile, quantiles, rules, split
from veritab.plans.presets import ORDERS
from veritab import session
from veritab.session import materialize, removed_after, scratch_path, spread_evenly
from veritab.spec import TableSpec

SPEC = TableSpec(
    name="n", id_col="id", columns={"x": "numeric", "c": "category", "d": "category"}, ranges={"x": (0, 10)},
    allowed={"c": ("red", "blue")}, bad_values={"x": (99,)}, nudge=("x",),
)


def gappy(spark, n=400):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 4 != 0, (F.col("id") % 9).cast("double")).alias("x"),
        F.when(F.col("id") % 3 == 0, "red").alias("c"),
        F.when(F.col("id") % 5 == 0, "blue").alias("d"),
    )


def test_near_copies_change_a_value_that_is_there(spark):
    planted = inject.inject_errors(gappy(spark), SPEC, 0.1)
    source = planted.table.select(F.col("id").alias("duplicate_of"), *[F.col(c).alias(f"s_{c}") for c in SPEC.features])
    near = planted.row_truth.filter("error_types = 'near_duplicate'").select("id", "duplicate_of")
    rows = near.join(planted.table, "id").join(source, "duplicate_of").collect()
    assert len(rows) == 40
    for r in rows:
        changed = [c for c in SPEC.features if r[c] != r[f"s_{c}"]]
        assert len(changed) == 1 and r[changed[0]] is not None and r[f"s_{changed[0]}"] is not None


def test_rows_without_any_value_are_never_near_copies(spark):
    frame = gappy(spark).withColumn("x", F.when(F.col("id") < 300, F.col("x")))
    empty = {r["id"] for r in frame.filter("x IS NULL AND c IS NULL AND d IS NULL").collect()}
    planted = inject.inject_errors(frame, SPEC, 0.1)
    near = planted.row_truth.filter("error_types = 'near_duplicate'").collect()
    assert empty and len(near) == 40 and not empty & {r["duplicate_of"] for r in near}


def test_a_spec_without_anything_to_change_is_an_error(spark):
    spec = TableSpec(name="s", id_col="id", columns={"x": "numeric"}, bad_values={"x": (1,)})
    with pytest.raises(ValueError, match="near copy"):
        inject.inject_errors(spark.range(50).selectExpr("id", "1D AS x"), spec)


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(i, x, "red") for i, x in enumerate([1.0, 2.0, float("nan"), None, 4.0, 99.0])], "id long, x double, c string")
    spec = TableSpec(name="s", id_col="id", columns={"x": "numeric", "c": "category"}, ranges={"x": (0, 10)}, nudge=("x",))
    labels = [r["x"] for r in rules.cell_rule_mask(frame, spec).orderBy("id").collect()]
    assert labels == ["", "", "missing", "missing", "", "out_of_range"]
    assert profile.column_stats(frame, ["x"])["x"].median == 3.0
    assert quantiles.quantiles(frame, {"x": F.col("x")}, [1.0]) == {"x": [99.0]}
    assert profile.distance_scales(frame, ["x"])["x"].median == 3.0


def test_quantiles_with_infinite_ends(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FETCH", 2)
    values = [float("-inf"), -1.7e308, -1.0, 0.0, 0.0, 3.0, 1.7e308, float("inf")]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    probabilities = [i / 7 for i in range(8)]
    assert quantiles.quantiles(frame, {"x": F.col("x")}, probabilities)["x"] == values


def test_whole_numbers_are_exact(spark):
    big = 9007199254740993
    frame = spark.createDataFrame([(big, str(big), -2.9), (-big, "1e3", 1e300), (None, "x", float("nan"))], "a long, b string, c double")
    got = [tuple(r) for r in clean.to_whole_numbers(frame, ["a", "b", "c"]).collect()]
    assert got == [(big, big, -2), (-big, 1000, None), (None, None, None)]


def test_ids_must_be_unique(spark):
    frame = gappy(spark, 40).withColumn("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")))
    with pytest.raises(ValueError, match="not unique"):
        inject.inject_errors(frame, SPEC)
    assert SPEC.check_ids(gappy(spark, 40)).count() == 40
    sides = split.split_by_record(frame, "id")  # a record may have several rows here; it stays on one side
    assert split.shared_records(sides.train(frame), sides.test(frame), "id").count() == 0


def test_only_ids_and_digests_are_exchanged_for_copies(spark):
    frame = gappy(spark).withColumn("d", F.concat("d", F.lit("long text")))
    found = copies.copied_rows(frame, SPEC.features, "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan.splitlines()[: next(i for i, line in enumerate(plan.splitlines()) if "sha2" in line)]
    assert any("Exchange hashpartitioning" in line for line in above)
    assert not any(re.search(r"\b[xcd]#", line) for line in above)
    want = {}
    for r in frame.collect():
        want.setdefault(tuple(r)[1:], []).append(r["id"])
    got = {r["id"]: (r["n_rows"], r["first_id"]) for r in found.collect()}
    assert got == {i: (len(ids), min(ids)) for ids in want.values() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("trees, per_tree", [(3, 10), (30, 60), (5, 400)])
def test_every_tree_draws_its_own_rows_at_every_size(spark, monkeypatch, trees, per_tree):
    """Below and above as many rows as all trees take together the samples follow the same rule."""
    monkeypatch.setattr(iforest, "_DRAWN", 64)  # so that the smallest are picked again and again
    rows = spark.range(400).withColumn("x", F.col("id") * 1.0)
    got = {}
    for r in iforest._tree_samples(rows, "id", 400, trees, per_tree, 7).collect():
        got.setdefault(r["tree"], set()).add(r["id"])
    assert sorted(got) == list(range(trees))
    digest = F.md5(F.concat_ws("|", F.lit("7"), F.lit("tree"), "id"))
    a, b = (F.conv(F.substring(digest, at, 12), 16, 10).cast("long") for at in (1, 13))
    drawn = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), a.alias("a"), b.alias("b")).select(
        "id", "t", ((F.col("a") + F.col("t") * F.col("b")) % iforest.DRAW_RANGE).alias("d")
    )
    want = {}
    for r in drawn.orderBy("t", "d", "id").collect():
        if len(want.setdefault(r["t"], set())) < per_tree:
            want[r["t"]].add(r["id"])
    assert got == want


def test_tables_written_inside_are_removed(spark, tmp_path):
    with removed_after(spark):
        inner = materialize(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    from pathlib import Path
    from urllib.parse import urlparse

    assert not Path(urlparse(path).path).exists()
    assert scratch_path(spark)


def test_injection_needs_two_scans(spark, folder, monkeypatch):
    """The wide cut that is needed on a small table gives the same picks as the narrow one."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    first = inject.pick_cells(orders, ORDERS, 42, 75)
    monkeypatch.setattr(inject, "_MARGIN", 1)
    assert inject.pick_cells(orders, ORDERS, 42, 75) == first


def test_rows_of_one_task_are_spread(spark, monkeypatch):
    """A file of one row group is read by one task; injection scans it several times."""
    monkeypatch.setattr(session, "_SPREAD_FROM", 1000)
    frame = gappy(spark, 2000)
    one = spread_evenly(frame.coalesce(1), "id")
    assert one.rdd.getNumPartitions() > 1 and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, frame.collect()), key=repr)
    even = frame.repartition(8)
    assert spread_evenly(even, "id") is even
