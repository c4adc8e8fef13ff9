import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from veritab.operators import clean
from veritab.plans.experiment import repeat_experiment, run_experiment
from veritab.plans.presets import CLINICAL, CLINICAL_WHOLE
from veritab.sources import files
from veritab.spec import TableSpec
from verification.compare import TABLES, canonical


def patients(spark, n=600):
    """Synthetic codes in the clinical layout, with a few incomplete rows."""
    h = "abs(xxhash64(id, '{}')) % {}"
    pick = {
        "age": f"29 + {h.format('a', 49)}", "sex": h.format("b", 2), "cp": f"1 + {h.format('c', 4)}",
        "trestbps": f"94 + {h.format('d', 100)}", "chol": f"126 + {h.format('e', 300)}",
        "fbs": f"int({h.format('f', 7)} = 0)", "restecg": h.format("g", 3),
        "thalach": f"71 + {h.format('h', 130)}", "exang": f"int({h.format('i', 3)} = 0)",
        "oldpeak": f"{h.format('j', 50)} / 10D", "slope": f"1 + {h.format('k', 3)}",
        "ca": f"IF(id % 150 = 7, NULL, {h.format('l', 4)})",
        "thal": f"element_at(array(3, 6, 7), int(1 + {h.format('m', 3)}))", "num": h.format("n", 5),
    }
    return spark.range(n).selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in pick.items()])


@pytest.fixture(scope="module")
def clinical(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "csv")
    raw = patients(spark)
    files.write_csv(raw, path, header=False, missing="?")
    back = files.read_csv(spark, path, raw.schema, header=False, missing="?")
    return clean.load_clean(back, CLINICAL, CLINICAL_WHOLE)


def test_load_clean(clinical):
    assert clinical.columns == ["record_id", *CLINICAL.record_columns]
    row = clinical.agg(F.count("*").alias("n"), F.min("record_id"), F.max("record_id"), F.countDistinct("record_id")).first()
    assert tuple(row) == (596, 0, 595, 596)
    assert {r[0] for r in clinical.select("thal").distinct().collect()} == set(CLINICAL.allowed["thal"])


def test_decode_and_casts(spark):
    df = spark.createDataFrame([(3.0, "12.9"), (6.0, "x"), (99.0, None)], "code double, t string")
    out = df.select(clean.decode(F.col("code"), {3: "a", 6: "b"}), clean.whole_number(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("a", 12), ("b", None), (None, None)]


def test_select_columns_turns_nan_into_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, y int")
    assert files.select_columns(df, ["y", "x"]).filter("x IS NULL").count() == 1


def test_spec_rejects_wrong_tables(spark):
    spec = TableSpec(name="s", id_col="id", columns={"x": "numeric"})
    with pytest.raises(ValueError, match="missing columns"):
        spec.validate(spark.range(1))
    with pytest.raises(ValueError, match="must be numeric"):
        spec.validate(spark.range(1).selectExpr("id", "'a' AS x"))
    with pytest.raises(ValueError, match="another role"):
        TableSpec(name="s", id_col="id", columns={"x": "category"}, ranges={"x": (0, 1)})


def test_experiment_reaches_the_published_quality(clinical):
    done = run_experiment(clinical, CLINICAL, trees=40, depth=15, row_trees=100)
    rows = {(r["method"], r["error_type"]): r for r in done.results.collect()}
    assert len(rows) == 21
    for method in ("Rules", "Random Forest"):
        assert rows[method, "missing"]["f1"] == 1.0
        assert rows[method, "exact_duplicate"]["f1"] >= 0.95
    assert rows["Rules", "unit_inconsistency"]["f1"] == 0.0
    assert rows["Random Forest", "unit_inconsistency"]["f1"] >= 0.8
    assert rows["Random Forest", "out_of_range"]["f1"] >= 0.8
    assert rows["Random Forest", "near_duplicate"]["f1"] >= 0.7
    assert rows["Random Forest", "any_error"]["f1"] >= 0.9
    assert rows["Isolation Forest", "any_error"]["roc_auc"] > 0.6
    assert done.forest.importances(12).count() == 12


def test_repeated_runs(clinical):
    summary = repeat_experiment(clinical, CLINICAL, seeds=[1, 2], trees=5, depth=8, row_trees=20)
    assert summary.count() == 21
    assert summary.filter("error_type = 'missing' AND method = 'Rules' AND f1_mean = 1").count() == 1


def test_contract(spark):
    flagship = contract.entry(spark)
    assert flagship.count() == 7
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["a3_csv_keeps_edge_spaces", "c13_cell_truth_wide", "d6_rule_mask", "e14_matched_pairs_part", "g10_result_table"])
def test_queries_equal_their_twins(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = contract.queries()[name](spark, folder)
    twin = db.sql(contract.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(twin.columns)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert repr(got) == repr(canonical(twin.columns, twin.fetchall()))
