from pyspark.sql import functions as F

from veritab.operators import cells, copies, rules
from veritab.operators.skew import heavy_lookup
from veritab.spec import TableSpec

SPEC = TableSpec(
    name="m1",
    id_col="id",
    columns={"age": "numeric", "sex": "category", "bp": "numeric"},
    target="num",
    ranges={"age": (18, 100), "bp": (80, 220)},
    allowed={"sex": ("male", "female")},
)
ROWS = [
    (1, 50.0, "male", 130.0, 0), (2, 50.0, "male", 130.0, 0), (3, None, "mael", 130.0, 0),
    (4, 648.0, "male", 17.3, 0), (5, None, "male", 90.0, 0), (6, None, "male", 90.0, 0),
    (7, 18.0, "female", 220.0, 0), (8, 50.0, "male", 130.0, 1),
]
SCHEMA = "id bigint, age double, sex string, bp double, num int"
EXPECTED = {
    1: ("", "", ""),
    2: ("exact_duplicate",) * 3,
    3: ("missing", "category_typo", ""),
    4: ("out_of_range", "", "out_of_range"),
    5: ("missing", "", ""),
    6: ("missing", "exact_duplicate", "exact_duplicate"),
    7: ("", "", ""),
    8: ("", "", ""),
}


def test_rule_mask(spark):
    mask = rules.apply_rules(spark.createDataFrame(ROWS, SCHEMA), SPEC)
    assert {r["id"]: (r["age"], r["sex"], r["bp"]) for r in mask.collect()} == EXPECTED


def test_wide_and_long_masks_agree(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    mask = rules.apply_rules(df, SPEC)
    back = cells.wide_mask(cells.labelled_cells(mask, SPEC), df, SPEC)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mask.collect()))


def test_copy_counts_ignore_the_target(spark):
    found = copies.copy_counts(spark.createDataFrame(ROWS, SCHEMA), SPEC.features, "id")
    counts = {r["id"]: (r["n_exact_copies"], r["n_earlier_copies"]) for r in found.collect()}
    assert counts == {1: (2, 0), 2: (2, 1), 8: (2, 2), 5: (1, 0), 6: (1, 1)}


def test_one_group_holds_a_third_of_the_rows(spark):
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("key")
    )
    found = copies.copy_counts(df, ["key"], "id")
    hot = found.join(df, "id").filter("key = -1")
    row = hot.agg(
        F.count("*").alias("n"), F.min("n_exact_copies"), F.max("n_exact_copies"),
        F.countDistinct("n_earlier_copies").alias("ranks"), F.max("n_earlier_copies"),
    ).first()
    assert tuple(row) == (10_000, 9_999, 9_999, 10_000, 9_999)
    assert hot.filter("n_earlier_copies != id / 3").count() == 0


def test_heavy_lookup_keeps_every_row(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 700 END AS k")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k IS NULL OR k % 2 = 0")
    out = heavy_lookup(rows, sizes, ["k"], "n", "id")
    want = rows.join(sizes.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left")
    assert sorted(map(repr, out.select("id", "n").collect())) == sorted(map(repr, want.select("id", "n").collect()))


def test_heavy_rows_do_not_share_a_join_key(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, -1, id % 700) AS k")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = heavy_lookup(rows, sizes, ["k"], "n", "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The spread value is part of the exchange's key; a folded constant would not be.
    assert "hashpartitioning(_spread" in plan
    assert out.filter("n IS NULL").count() == 0


def test_cell_rules_take_a_stream(spark, folder, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    writer = rules.cell_rule_mask(stream, SPEC).writeStream.format("memory").queryName("rule_stream")
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination(60)
    streamed = sorted(map(tuple, spark.table("rule_stream").collect()))
    batch = rules.cell_rule_mask(spark.createDataFrame(ROWS, SCHEMA), SPEC)
    assert streamed == sorted(map(tuple, batch.collect()))


def test_only_possible_keys_are_exchanged(spark):
    from veritab.operators.skew import possible, sparse_lookup

    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.filter("id % 100 = 0").select("h")
    passed = possible(rows, keys, "h")
    assert passed.columns == rows.columns
    assert passed.join(keys, "h", "left_semi").count() == 200 and passed.count() < 3000
    assert possible(rows, keys.limit(0), "h").count() == 0
    few = spark.range(0, 20_000, 100).select("id", F.lit(True).alias("late"))
    some = rows.select(F.when(F.col("id") > 10, F.col("id")).alias("id"), "h")
    assert sorted(map(tuple, sparse_lookup(some, few, "id").collect()), key=repr) == sorted(map(tuple, some.join(few, "id", "left").select("id", "h", "late").collect()), key=repr)


def test_copy_search_exchanges_no_digest_of_single_records(spark):
    """The records that occur once go as far as an 8-byte hash."""
    frame = spark.range(10_000).selectExpr("id", "CASE WHEN id < 40 THEN 'same' ELSE concat('text ', id) END AS t")
    found = copies.copied_rows(frame, ["t"], "id")
    assert found.count() == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("Join Inner")
