import pytest
from pyspark.sql import functions as F

from veritab.operators import cells, forest, inject, pick, score, split
from veritab.operators.iforest import (
    average_path,
    fit_isolation_forest,
    flag_most_anomalous,
)
from veritab.plans.presets import ORDERS
from veritab.spec import CELL_ERROR_TYPES, ERROR_TYPES, TableSpec


@pytest.fixture(scope="module")
def orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet")


@pytest.fixture(scope="module")
def injected(orders):
    return inject.inject_errors(orders, ORDERS, 0.05, 42)


def test_budget_rounds_half_even():
    assert [inject.error_budget(n, 0.05) for n in (297, 10, 50, 70, 3)] == [15, 1, 2, 4, 1]


def test_every_type_has_its_budget(injected):
    counts = {r["error_type"]: r["count"] for r in inject.error_summary(injected.cell_truth, ORDERS).collect()}
    assert list(counts) == list(ERROR_TYPES) and set(counts.values()) == {75}


def test_truth_is_what_changed(orders, injected):
    after = injected.table.filter("o_orderkey < 1500").withColumnsRenamed({c: f"new_{c}" for c in ORDERS.features})
    both = orders.join(after, "o_orderkey")
    changed = [
        F.when(~F.col(c).cast("string").eqNullSafe(F.col(f"new_{c}").cast(orders.schema[c].dataType).cast("string")), F.lit(c))
        for c in ORDERS.features
    ]
    seen = both.select("o_orderkey", F.explode(F.array_compact(F.array(*changed))).alias("column"))
    planted = injected.cell_truth.filter(F.col("label").isin(*CELL_ERROR_TYPES))
    assert orders.agg(F.max("o_orderkey")).first()[0] < 1500
    assert seen.exceptAll(planted.select("o_orderkey", "column")).count() == 0
    assert planted.select("o_orderkey", "column").exceptAll(seen).count() == 0
    assert planted.groupBy("o_orderkey", "column").count().filter("count > 1").count() == 0


def test_copies_come_later_and_differ_as_labelled(injected):
    copies = injected.row_truth.filter("duplicate_of is not null")
    assert copies.filter("duplicate_of >= o_orderkey").count() == 0
    assert injected.table.groupBy("o_orderkey").count().filter("count > 1").count() == 0
    sources = injected.table.withColumnsRenamed(
        {c: f"s_{c}" for c in ORDERS.features} | {"o_orderkey": "duplicate_of"}
    )
    joined = injected.table.join(copies, "o_orderkey").join(sources, "duplicate_of")
    changes = sum((~F.col(c).eqNullSafe(F.col(f"s_{c}"))).cast("int") for c in ORDERS.features)
    found = joined.groupBy("error_types").agg(F.min(changes), F.max(changes)).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {"exact_duplicate": (0, 0), "near_duplicate": (1, 1)}
    assert injected.row_truth.join(copies.select(F.col("duplicate_of").alias("o_orderkey")), "o_orderkey").filter("is_dirty").count() == 0


def test_partitioning_and_seed(orders, injected):
    again = inject.inject_errors(orders.repartition(7, "o_custkey"), ORDERS, 0.05, 42)
    assert score.same_rows(injected.table, again.table).count() == 0
    other = inject.inject_errors(orders, ORDERS, 0.05, 43)
    assert score.same_rows(injected.table, other.table).count() > 0


def test_too_few_candidates_is_an_error(spark):
    spec = TableSpec(name="s", id_col="id", columns={"x": "numeric"}, bad_values={"x": (1,)}, nudge=("x",))
    with pytest.raises(ValueError, match="cannot pick"):
        inject.inject_errors(spark.range(3).selectExpr("id", "1D AS x"), spec, 0.9)


def test_cutoffs_refine_to_the_exact_rank(spark, monkeypatch):
    monkeypatch.setattr(pick, "_FETCH", 2)
    df = spark.range(20_000)
    digest = F.md5(F.col("id").cast("string"))
    ordered = sorted(r[0] for r in df.select(digest).collect())
    ks = [0, 1, 777, 20_000]
    assert pick.digest_cutoffs(df, digest, ks) == ["", ordered[0], ordered[776], ordered[-1]]


S_SPEC = TableSpec(name="s", id_col="id", columns={f"c{i}": "numeric" for i in range(13)})


def long_cells(spark, rows):
    return spark.createDataFrame(rows, "id bigint, column string, label string")


def test_hand_worked_cell_scores(spark):
    x, y = "missing", "out_of_range"
    truth = long_cells(spark, [(1, "c0", x), (2, "c0", x)])
    guess = long_cells(spark, [(1, "c0", x), (2, "c0", y), (3, "c0", x)])
    rows = {r["error_type"]: r for r in score.score_cells(truth, guess, S_SPEC, "m").collect()}
    assert tuple(rows[x])[3:] == (2, 0.5, 0.5, 0.5, 1.0)
    assert tuple(rows["category_typo"])[3:] == (0, 0.0, 0.0, 0.0, None)


def test_majority_needs_more_than_half(spark):
    def row(i, **labels):
        names = [label for label, n in labels.items() for _ in range(n)]
        return [(i, f"c{k}", label) for k, label in enumerate(names)]

    found = score.majority_labels(long_cells(spark, row(1, X=7) + row(2, X=6) + row(3, X=6, Y=7)), S_SPEC)
    assert {r["id"]: r["label"] for r in found.collect()} == {1: "X", 3: "Y"}
    four = TableSpec(name="f", id_col="id", columns={f"c{i}": "numeric" for i in range(4)})
    assert score.majority_labels(long_cells(spark, row(1, X=2)), four).count() == 0


def test_roc_auc_with_ties(spark):
    rows = [(1, .9), (0, .9), (1, .8), (0, .1), (0, .2), (1, .15)]
    df = spark.createDataFrame([(bool(a), b) for a, b in rows], "y boolean, s double")
    assert score.roc_auc(df, "s", "y").first()[0] == pytest.approx(5.5 / 9)
    assert score.roc_auc(df.filter("y"), "s", "y").first()[0] is None


def test_weights_and_review_budget(spark):
    labels = spark.createDataFrame([("clean",)] * 6 + [("X",)] * 3 + [("Y",)], "label string")
    weights = {r["label"]: r["weight"] for r in forest.balanced_weights(labels).collect()}
    assert weights == pytest.approx({"clean": 0.555556, "X": 1.111111, "Y": 3.333333}, abs=1e-6)
    scores = spark.range(1, 11).selectExpr("id", "CAST(id AS DOUBLE) AS score")
    assert [r["id"] for r in flag_most_anomalous(scores, 0.10).filter("flagged").collect()] == [10]


def test_run_summary_and_tables(spark):
    columns = "method string, error_type string, level string, support bigint, precision double, recall double, f1 double, recall_any double, roc_auc double"
    runs = spark.createDataFrame(
        [("m", "missing", "cell", 2, 1.0, 1.0, 1.0, 1.0, None), ("m", "missing", "cell", 3, 0.5, 0.5, 0.5, None, None)],
        columns,
    )
    row = score.summarize_runs(runs).first()
    assert tuple(row)[2:] == (5, 0.75, 0.75, 0.75, 0.354, 1.0, None)
    wide = score.comparison_table(runs, ["m"]).first()
    assert wide["error_type"] == "missing" and wide["m:f1"] == 1.0
    assert score.chart_rows(score.summarize_runs(runs), ["m"]).count() == 2


def test_split_shares_no_record(spark):
    ids = spark.range(327).withColumnRenamed("id", "record_id")
    sides = split.split_by_record(ids, "record_id", 0.3, 42)
    train, test = sides.train(ids), sides.test(ids)
    assert (train.count(), test.count()) == (228, 99)
    assert split.shared_records(train, test, "record_id").count() == 0


def test_isolation_constants():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.244771, abs=1e-6)


def test_isolation_forest_ranks_outliers(injected):
    model = fit_isolation_forest(injected.table, ORDERS, trees=40, seed=1)
    assert model.nodes.groupby("tree").size().max() <= 511
    scores = model.score(injected.table)
    assert scores.count() == injected.table.count()
    area = score.roc_auc(scores.join(injected.row_truth, "o_orderkey"), "score", "is_dirty").first()[0]
    assert area > 0.55
    again = fit_isolation_forest(injected.table.repartition(3), ORDERS, trees=40, seed=1).score(injected.table)
    assert score.same_rows(scores, again).count() == 0


def test_disjoint_samples_on_larger_tables(spark):
    spec = TableSpec(name="d", id_col="id", columns={"x": "numeric"})
    df = spark.range(5000).selectExpr("id", "CASE WHEN id = 77 THEN 1e6 ELSE CAST(id % 100 AS DOUBLE) END AS x")
    model = fit_isolation_forest(df, spec, trees=20, rows_per_tree=64, seed=2)
    assert model.nodes["tree"].nunique() == 20
    scored = model.score(df)
    outlier = scored.filter("id = 77").first()["score"]
    assert outlier > 0.6 and scored.filter(F.col("score") > outlier).count() < 250


def test_flag_crosstab_and_examples(injected):
    flagged = injected.table.filter("o_orderkey < 10").select("o_orderkey")
    total = sum(r["n"] for r in score.flag_crosstab(injected.row_truth, flagged, "o_orderkey").collect())
    assert total == injected.table.count()
    shown = score.dirty_examples(injected.table, injected.mask, "o_orderkey", 6)
    assert shown.count() == 6


def test_label_crosstab_covers_every_cell(injected):
    truth = injected.cell_truth
    table = score.label_crosstab(truth, truth, injected.table, ORDERS).collect()
    assert sum(r["n"] for r in table) == injected.table.count() * 4
    assert all(r["truth"] == r["guess"] for r in table)
    assert cells.all_cells(injected.table, "o_orderkey", ORDERS.features).count() == injected.table.count() * 4


def test_masks_of_wide_tables_equal_plain_counts(spark):
    """More columns than one mask holds, labels that no type knows, and a majority on either side."""
    import random

    from veritab.operators import score
    from veritab.spec import CELL_ERROR_TYPES, ERROR_TYPES, TableSpec

    spec = TableSpec(name="w", id_col="id", columns={f"c{i}": "numeric" for i in range(130)})
    rng = random.Random(3)
    sides = []
    for _ in range(2):
        cells = {}
        for i in range(40):
            whole = rng.choice([None, None, "exact_duplicate", "near_duplicate"])
            for c in spec.features:
                label = whole if whole and rng.random() < 0.7 else rng.choice([None] * 12 + [*ERROR_TYPES, "other"])
                if label:
                    cells[i, c] = label
        sides.append(cells)
    truth, guess = sides
    frames = [spark.createDataFrame([(i, c, label) for (i, c), label in s.items()], "id long, column string, label string") for s in sides]
    got = {r["error_type"]: r for r in score.score_by_type(*frames, spec, "m").collect()}
    for e in ERROR_TYPES:
        if e in CELL_ERROR_TYPES:
            t, g, any_g = {k for k, v in truth.items() if v == e}, {k for k, v in guess.items() if v == e}, set(guess)
        else:
            most = lambda s: {i for i in range(40) if 2 * sum(s.get((i, c)) == e for c in spec.features) > 130}  # noqa: B023, E731
            t, g, any_g = most(truth), most(guess), {i for i, _ in guess}
        hits = len(t & g)
        assert got[e]["support"] == len(t)
        assert got[e]["precision"] == pytest.approx(hits / len(g) if g else 0)
        assert got[e]["recall"] == pytest.approx(hits / len(t) if t else 0)
        assert got[e]["recall_any"] == (pytest.approx(len(t & any_g) / len(t)) if t else None)


def test_row_vectors_reach_mllib(spark):
    from pyspark.ml.clustering import KMeans

    from veritab.operators.iforest import fit_matrix
    from veritab.operators.vectors import row_vectors, vocabulary
    from veritab.spec import TableSpec

    spec = TableSpec(name="v", id_col="id", columns={"x": "numeric", "c": "category", "d": "category"})
    rows = [(i, None if i == 3 else float(i % 4), "ab"[i % 2] if i else None, "p") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, x double, c string, d string")
    matrix = fit_matrix(df, spec)
    words = [(r["column"], r["value"], r["place"]) for r in vocabulary(matrix.apply(df), matrix).orderBy("place").collect()]
    assert words == [("c", "b", 0), ("c", "a", 1), ("d", "p", 2)] or words == [("c", "a", 0), ("c", "b", 1), ("d", "p", 2)]
    vectors = row_vectors(df, matrix)
    first = {r["id"]: r["features"] for r in vectors.collect()}
    assert all(v.size == 1 + 3 + 3 for v in first.values())
    dense = first[3].toArray()
    assert dense[1] == 1.0 and dense[0] == 0.0 and dense[4:].sum() == 2.0
    assert KMeans(k=2, seed=1).fit(vectors).transform(vectors).count() == 20
    numbers = TableSpec(name="v", id_col="id", columns={"x": "numeric"})
    assert row_vectors(df.select("id", "x"), fit_matrix(df, numbers)).first()["features"].size == 2


def test_forest_is_fitted_and_applied_in_groups_of_trees(spark, monkeypatch):
    """Only a group's nodes are on the driver; all trees are fitted and vote."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from veritab.operators.features import feature_names

    names = feature_names(ORDERS)
    rows = spark.range(400).select(
        F.col("id").alias("o_orderkey"), F.lit("o_totalprice").alias("column"),
        *[(F.col("id") % 2 if n == "is_null" else F.xxhash64("id", F.lit(n)) % 5).cast("double").alias(n) for n in names],
        F.when(F.col("id") % 2 == 1, "missing").otherwise("clean").alias("label"),
    )
    monkeypatch.setattr(forest, "GROUP_CELLS", 1600)
    model = forest.train_forest(rows, ORDERS, trees=10, depth=6)
    assert [RandomForestClassificationModel.load(p).getNumTrees for p in model.groups] == [4, 4, 2]
    assert sorted(r["o_orderkey"] for r in model.predict(rows).filter("label = 'missing'").collect()) == list(range(1, 400, 2))
    assert model.predict(rows).count() == 200
    assert abs(sum(model.weights) - 1) < 1e-9 and max(model.weights) == model.weights[names.index("is_null")]


def test_forest_is_fitted_on_all_cells(spark, monkeypatch):
    """More than a million cells' worth of records: none is left out of the fit."""
    from veritab.operators.features import feature_names

    names, n = feature_names(ORDERS), 250_100
    rows = spark.range(n).select(
        F.col("id").alias("o_orderkey"), F.lit("o_totalprice").alias("column"),
        *[(F.col("id") % 2 if f == "is_null" else F.lit(0)).cast("double").alias(f) for f in names],
        F.when(F.col("id") % 2 == 1, "missing").otherwise("clean").alias("label"),
    )
    weighed, made = [], forest.balanced_weights

    def seen(cells, label="label"):
        weighed.append(cells.count())
        return made(cells, label)

    monkeypatch.setattr(forest, "balanced_weights", seen)
    forest.train_forest(rows, ORDERS, trees=1, depth=2)
    assert weighed == [n]
