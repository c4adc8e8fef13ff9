"""Headline timings: one JSON line on stdout. Reads $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from verification.queries import EVENTS, LINEITEM, ORDERS, PART, RULES  # noqa: E402
from veritab.operators.complete import complete_pairs  # noqa: E402
from veritab.operators.copies import copy_counts  # noqa: E402
from veritab.operators.features import column_features  # noqa: E402
from veritab.operators.iforest import fit_isolation_forest  # noqa: E402
from veritab.operators.inject import inject_errors  # noqa: E402
from veritab.operators.keyed import keyed_pairs  # noqa: E402
from veritab.operators.nearest import nearest_pairs  # noqa: E402
from veritab.operators.profile import summary, value_counts  # noqa: E402
from veritab.operators.rules import cell_rule_mask, rule_cells  # noqa: E402
from veritab.operators.score import roc_auc, score_by_type  # noqa: E402


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem").selectExpr(
        "l_orderkey * 100 + l_linenumber AS line_id", *LINEITEM.features
    )
    orders, part, events = table("orders"), table("part"), table("events")
    stored = {}

    def inject() -> None:
        stored["orders"] = inject_errors(orders, ORDERS)

    def scores() -> None:
        found = stored["orders"]
        run(score_by_type(found.cell_truth, rule_cells(found.table, ORDERS), ORDERS, RULES))

    jobs = {
        "cell_rules_lineitem": lambda: run(cell_rule_mask(lines, LINEITEM)),
        "summary_lineitem": lambda: run(summary(lines, LINEITEM.numbers)),
        "value_counts_lineitem": lambda: run(value_counts(lines, LINEITEM)),
        "inject_orders": inject,
        "rule_scores_orders": scores,
        "column_features_orders": lambda: run(column_features(orders, ORDERS)),
        "copy_counts_events": lambda: run(copy_counts(events, ["event_type"], "event_id")),
        "nearest_keyed_orders": lambda: run(keyed_pairs(orders, ORDERS)),
        "nearest_complete_orders": lambda: run(complete_pairs(orders, ORDERS)),
        "nearest_exact_part": lambda: run(nearest_pairs(part, PART)),
        "nearest_radius_events": lambda: run(nearest_pairs(events, EVENTS, within=0.05)),
        "roc_auc_events": lambda: run(
            roc_auc(events.selectExpr("value", "event_type = 'purchase' AS bought"), "value", "bought")
        ),
        "isolation_forest_events": lambda: run(
            fit_isolation_forest(events, EVENTS, trees=100).score(events)
        ),
        "isolation_forest_300_events": lambda: run(fit_isolation_forest(events, EVENTS).score(events)),
    }
    run(orders)  # starts the executors before the first timing
    times = {}
    for name, job in jobs.items():
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
