"""Work that a comparison does once and not again for every scan or seed."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import features, nearest
from veritab.plans import experiment
from veritab.spec import TableSpec

SPEC = TableSpec(name="t", id_col="id", columns={"a": "numeric", "c": "category"}, nudge=("a",), allowed={"c": ("x", "y")})


def test_profiles_of_cell_features_do_not_join_again(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    mask = df.select("id", F.lit("").alias("a"), F.lit("missing").alias("c"))
    plans, made = [], features.column_stats

    def seen(table, columns):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return made(table, columns)

    monkeypatch.setattr(features, "column_stats", seen)
    cells = features.build_cell_features(df, SPEC, "exact", mask)
    assert len(plans) == 1 and "Join" not in plans[0]
    assert cells.count() == 120 and {r["label"] for r in cells.filter("column = 'c'").collect()} == {"missing"}


def test_seeds_share_the_check_of_ids_and_an_even_table(spark, monkeypatch):
    rows, cores = 120_000, spark.sparkContext.defaultParallelism
    clean = spark.range(0, rows, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit("x").alias("c"))
    calls = []

    def run(table, spec, seed, checked=False, **options):
        sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
        calls.append((seed, checked, sum(sizes), max(sizes)))
        results = spark.createDataFrame([("m", "e", "row", 1, 0.5, 0.5, 0.5, 0.5, 0.5)], "method string, error_type string, level string, support long, precision double, recall double, f1 double, recall_any double, roc_auc double")
        return SimpleNamespace(results=results)

    monkeypatch.setattr(experiment, "run_experiment", run)
    assert experiment.repeat_experiment(clean, SPEC, [1, 2, 3]).first()["support_total"] == 3
    assert sorted(c[:3] for c in calls) == [(s, True, rows) for s in (1, 2, 3)]
    assert cores < 2 or max(c[3] for c in calls) <= rows / 2
    with pytest.raises(ValueError, match="not unique"):
        experiment.repeat_experiment(clean.limit(5).unionByName(clean.limit(5)), SPEC, [1])


@pytest.mark.parametrize("within", [None, 3.0, float("inf")])
def test_nearest_earlier_of_infinite_and_missing_distances(within):
    r = np.random.default_rng(5)
    a = r.choice([0.0, 1.0, 2.5, 40.0, np.inf, -np.inf, np.nan], 700)
    c = r.integers(0, 3, 700)
    ids = np.sort(r.choice(5000, 700, replace=False))
    with np.errstate(invalid="ignore"):
        found, partner = nearest._earlier([a, c], ids, [a, c], ids, 1, within)
        for i in range(700):
            gaps = np.abs(a[i] - a[:i]) + (c[i] != c[:i])
            gaps = np.where(np.isnan(gaps), np.inf, gaps)
            at = np.flatnonzero(gaps <= (np.inf if within is None else within))
            best = at[gaps[at].argmin()] if len(at) else None
            assert partner[i] == (nearest._NOBODY if best is None else ids[best])
            assert found[i] == (np.inf if best is None else gaps[best])
