"""Run registered queries and their DuckDB twins side by side: ``python -m verification.compare [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from verification.queries import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def main(wanted: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            result = db.sql(ORACLE[name])
            want = canonical(result.columns, result.fetchall())
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: oracle {str(error)[:600]}", flush=True)
            continue
        same = sorted(frame.columns) == sorted(result.columns) and repr(got) == repr(want)
        bad += not same
        print(
            f"{'ok  ' if same else 'DIFF'} {name}: {len(got)} rows {took:.1f}s, twin {len(want)} rows "
            f"{time.time() - start:.1f}s", flush=True,
        )
        if not same:
            print("   columns", sorted(frame.columns), sorted(result.columns))
            theirs, ours = set(map(repr, want)), set(map(repr, got))
            print("   only here", sorted(ours - theirs)[:4], len(ours - theirs))
            print("   only twin", sorted(theirs - ours)[:4], len(theirs - ours), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
