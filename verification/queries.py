"""The registered queries: one or more per operator, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veritab.functions.hashing import column, draw
from veritab.functions.text import (
    differs_by_case_only,
    edit_distance_to,
    has_case_mismatch,
    has_edge_space,
    misspell,
)
from veritab.operators import (
    cells,
    clean,
    complete,
    copies,
    features,
    forest,
    iforest,
    inject,
    keyed,
    labels,
    nearest,
    profile,
    rules,
    score,
    split,
    vectors,
)
from veritab.operators.quantiles import quantile_frame
from veritab.operators.rank import ordered_index
from veritab.plans.experiment import CELL_FOREST, ROW_FOREST, RULES, repeat_experiment, run_experiment, score_detectors
from veritab.plans.presets import CUSTOMER, EVENTS, LINEITEM, ORDERS, PART
from veritab.session import materialize, scratch_path, spread_evenly
from veritab.sources import files
from veritab.spec import CELL_ERROR_TYPES, CLEAN, ERROR_TYPES, ROW_ERROR_TYPES, TableSpec
from verification import oracle as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEED, RATE = sql.SEED, sql.RATE


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if twin is not None:
            ORACLE[name] = twin
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """Fractional columns at six digits, so that summation order does not show."""
    return df.select(*[
        r6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


_stored: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """Inputs several queries share are built once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def injected(spark: SparkSession, folder: str, spec: TableSpec = ORDERS) -> inject.Injected:
    return once(
        spark, folder, f"injected {spec.name}",
        lambda: inject.inject_errors(table(spark, folder, spec.name), spec, RATE, SEED),
    )


def rule_mask(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "rule mask",
        lambda: materialize(rules.apply_rules(injected(spark, folder).table, ORDERS)),
    )


def rule_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells.labelled_cells(rule_mask(spark, folder), ORDERS)


def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        found = injected(spark, folder)
        return materialize(features.build_cell_features(found.table, ORDERS, mask=found.mask))

    return once(spark, folder, "cell features", build)


INJ = sql.injected(ORDERS, "orders")
RULED = INJ + sql.rules(ORDERS)
SCORED = RULED + sql.scoring(ORDERS)
FEATS = ", ".join(ORDERS.features)
INJ_STATS = INJ + ",\n" + sql.stats(ORDERS, "inj")
_ID = "id AS o_orderkey"


# --- A: sources and sinks -------------------------------------------------------------------

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("a1_csv_with_header", CUSTOMER_SQL)
def a1(spark, folder):
    source, path = table(spark, folder, "customer"), scratch_path(spark)
    files.write_csv(source, path)
    return files.read_csv(spark, path, source.schema)


@query(
    "a2_csv_headerless_missing_mark",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer",
)
def a2(spark, folder):
    source, path = table(spark, folder, "customer"), scratch_path(spark)
    gaps = source.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    files.write_csv(gaps, path, header=False, missing="?")
    return files.read_csv(spark, path, source.schema, header=False, missing="?")


@query("a3_csv_keeps_edge_spaces", INJ + f" SELECT {_ID}, {FEATS} FROM inj")
def a3(spark, folder):
    found, path = injected(spark, folder).table, scratch_path(spark)
    files.write_csv(found, path)
    return files.read_csv(spark, path, found.schema)


_BROKEN_NAME = "CASE c_custkey % 5 WHEN 0 THEN c_name || chr(10) || ' \"a, b\" ' WHEN 1 THEN ' ' || chr(13) || chr(10) || c_name WHEN 2 THEN '' WHEN 3 THEN NULL ELSE c_name END"


@query("a3_csv_keeps_line_breaks", f"SELECT c_custkey, {_BROKEN_NAME} AS c_name, c_acctbal FROM customer")
def a3_breaks(spark, folder):
    source, path = table(spark, folder, "customer"), scratch_path(spark)
    texts = source.selectExpr("c_custkey", f"{_BROKEN_NAME} AS c_name", "c_acctbal")
    files.write_csv(texts, path, missing="\\N")
    return files.read_csv(spark, path, texts.schema, missing="\\N")


_BAD_LINES = (
    "CASE WHEN c_custkey % 7 = 0 THEN concat_ws(',', c_custkey, c_name, 'n/a', c_mktsegment) "
    "WHEN c_custkey % 11 = 0 THEN concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment, 'more') "
    "WHEN c_custkey % 13 = 0 THEN concat_ws(',', c_custkey, c_name) "
    "WHEN c_custkey % 17 = 0 THEN concat_ws(',', concat(c_custkey, '.5'), c_name, 'x', c_mktsegment) "
    "ELSE concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment) END"
)


@query(
    "a2_csv_bad_records",
    "SELECT record, reason FROM (SELECT "
    + _BAD_LINES
    + " AS record, CASE WHEN c_custkey % 7 = 0 THEN 'c_acctbal is not double' WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'not 4 fields' "
    "WHEN c_custkey % 17 = 0 THEN 'c_custkey is not bigint; c_acctbal is not double' END AS reason FROM customer) "
    "WHERE reason IS NOT NULL UNION ALL SELECT concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment), NULL FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 "
    "AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0",
)
def a2_bad(spark, folder):
    path = scratch_path(spark)
    table(spark, folder, "customer").selectExpr(f"{_BAD_LINES} AS value").write.text(path)
    schema = T.StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")
    read = files.read_csv_checked(spark, path, schema, header=False)
    good = F.concat_ws("|", "c_custkey", "c_name", F.col("c_acctbal").cast("bigint"), "c_mktsegment")
    return read.rows.select(good.alias("record"), F.lit(None).cast("string").alias("reason")).unionByName(read.bad.select("record", "reason"))


@query("a3_parquet_round_trip", INJ + f" SELECT {_ID}, {FEATS} FROM inj")
def a3_parquet(spark, folder):
    path = scratch_path(spark)
    files.write_parquet(injected(spark, folder).table, path)
    return files.read_parquet(spark, path)


@query("a4_select_columns", "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def a4(spark, folder):
    return files.select_columns(table(spark, folder, "orders"), [ORDERS.id_col, *ORDERS.features])


# --- B: cleaning ----------------------------------------------------------------------------


@query(
    "b1_complete_rows",
    "SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders "
    "WHERE o_orderpriority <> '5-LOW'",
)
def b1(spark, folder):
    gaps = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS o_orderpriority"
    )
    return clean.complete_rows(gaps)


@query(
    "b2_whole_numbers",
    "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS p_retailprice, TRY_CAST(p_name AS DOUBLE)::BIGINT AS p_name FROM part",
)
def b2(spark, folder):
    source = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_name")
    return clean.to_whole_numbers(source, ["p_retailprice", "p_name"])


NATION_LABELS = {0: "zero", 1: "one", 2: "two", 7: "seven", 24: "last"}


@query(
    "b3_decode_codes",
    "SELECT c_custkey, CASE c_nationkey "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NATION_LABELS.items())
    + " END AS c_nation FROM customer",
)
def b3(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", clean.decode(F.col("c_nationkey"), NATION_LABELS).alias("c_nation")
    )


LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "lines",
        lambda: materialize(
            clean.assign_record_id(table(spark, folder, "lineitem"), "line_id", LINE_COLUMNS)
        ),
    )


@query(
    "b4_record_id",
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) - 1 AS line_id, {', '.join(LINE_COLUMNS)} FROM lineitem",
)
def b4(spark, folder):
    return numbered_lines(spark, folder).select("line_id", *LINE_COLUMNS)


@query(
    "b5_record_ids",
    "SELECT 'orders' AS name, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS accepted "
    "UNION ALL SELECT 'events', (SELECT count(*) = count(DISTINCT event_id) FROM events) "
    "UNION ALL SELECT 'lineitem', (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem)",
)
def b5(spark, folder):
    """Whether each table's ids name its records."""
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", LINEITEM.id_col)
    frames = ((ORDERS, table(spark, folder, "orders")), (EVENTS, table(spark, folder, "events")), (LINEITEM, lines))
    rows = []
    for spec, df in frames:
        try:
            spec.check_ids(spec.validate(df))
            rows.append((spec.name, True))
        except ValueError:
            rows.append((spec.name, False))
    return spark.createDataFrame(rows, "name string, accepted boolean")


_GAPPY = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS o_totalprice, "
    "nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders"
)


@query(
    "d4_rules_on_gaps",
    "SELECT o_orderkey, "
    + ", ".join(
        sql.rule_label(ORDERS, c, None).replace(f"{c} IS NULL", f"{c} IS NULL OR isnan({c}::DOUBLE)" if c in ORDERS.numbers else f"{c} IS NULL")
        + f" AS {c}" for c in ORDERS.features
    )
    + f" FROM ({_GAPPY})",
)
def d4_gaps(spark, folder):
    """NaN and NULL both count as missing."""
    gaps = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN double('NaN') ELSE o_totalprice END AS o_totalprice",
        "nullif(o_orderpriority, '5-LOW') AS o_orderpriority", "o_custkey", "nullif(o_orderstatus, 'P') AS o_orderstatus",
    )
    return rules.cell_rule_mask(gaps, ORDERS)


# --- C: injection ---------------------------------------------------------------------------


def _labelled_values(spark: SparkSession, folder: str, label: str, columns: list[str]) -> DataFrame:
    found = injected(spark, folder)
    hits = found.cell_truth.filter(F.col("label") == label).select("o_orderkey", "column")
    value = F.coalesce(*[F.when(F.col("column") == c, F.col(c).cast("string")) for c in columns])
    out = found.table.join(hits, "o_orderkey")
    return out.select("o_orderkey", "column", value.alias("value"))


@query("c1_error_budget", INJ + " SELECT k AS n_errors FROM budget")
def c1(spark, folder):
    rows = table(spark, folder, "orders").count()
    return spark.createDataFrame([(inject.error_budget(rows, RATE),)], "n_errors bigint")


@query("c2_pick_cells", INJ + ' SELECT id AS o_orderkey, col AS "column", label FROM picks')
def c2(spark, folder):
    return injected(spark, folder).cell_truth.filter(F.col("label").isin(*CELL_ERROR_TYPES))


@query("c3_missing", INJ + ' SELECT p.id AS o_orderkey, p.col AS "column" FROM pick_missing p')
def c3(spark, folder):
    found = injected(spark, folder)
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ORDERS.features]))
    return found.table.select("o_orderkey", F.explode(empty).alias("column"))


@query(
    "c4_out_of_range",
    INJ + " SELECT p.id AS o_orderkey, i.o_totalprice FROM pick_out_of_range p JOIN inj i ON i.id = p.id",
)
def c4(spark, folder):
    found = injected(spark, folder)
    hits = found.cell_truth.filter("label = 'out_of_range'").select("o_orderkey")
    return found.table.join(hits, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    "c5_misspell",
    "WITH src AS MATERIALIZED (SELECT c_custkey AS id, 'c_mktsegment' AS col, c_mktsegment AS v, "
    + sql.digest("demo", "c_custkey") + " AS dig FROM customer), t AS ("
    + sql.misspelled("src", CUSTOMER) + ") SELECT id AS c_custkey, typo FROM t",
)
def c5(spark, folder):
    typo = misspell("c_mktsegment", CUSTOMER.all_labels, draw(SEED, "demo", column("c_custkey")))
    return table(spark, folder, "customer").selectExpr("c_custkey", f"{typo} AS typo")


@query("c6_category_typo", INJ + ' SELECT id AS o_orderkey, col AS "column", typo AS value FROM typos')
def c6(spark, folder):
    return _labelled_values(spark, folder, "category_typo", ORDERS.categories)


@query(
    "c7_unit_inconsistency",
    INJ + " SELECT p.id AS o_orderkey, i.o_totalprice FROM pick_unit_inconsistency p JOIN inj i ON i.id = p.id",
)
def c7(spark, folder):
    found = injected(spark, folder)
    hits = found.cell_truth.filter("label = 'unit_inconsistency'").select("o_orderkey")
    return found.table.join(hits, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("c8_rows_without_error", INJ + " SELECT id AS o_orderkey FROM base WHERE id NOT IN (SELECT id FROM picks)")
def c8(spark, folder):
    return injected(spark, folder).row_truth.filter("NOT is_dirty").select("o_orderkey")


@query(
    "c9_exact_duplicates",
    INJ + " SELECT (SELECT last FROM budget) + rn AS o_orderkey, id AS duplicate_of FROM copied WHERE NOT near",
)
def c9(spark, folder):
    truth = injected(spark, folder).row_truth
    return truth.filter("error_types = 'exact_duplicate'").select("o_orderkey", "duplicate_of")


@query(
    "c10_near_duplicates",
    INJ + f" SELECT (SELECT last FROM budget) + rn AS o_orderkey, id AS duplicate_of, {FEATS} FROM copied WHERE near",
)
def c10(spark, folder):
    found = injected(spark, folder)
    near = found.row_truth.filter("error_types = 'near_duplicate'").select("o_orderkey", "duplicate_of")
    return found.table.join(near, "o_orderkey").select("o_orderkey", "duplicate_of", *ORDERS.features)


@query("c11_corrupted_table", INJ + f" SELECT {_ID}, {FEATS} FROM inj")
def c11(spark, folder):
    return injected(spark, folder).table


@query(
    "c12_shuffled_file_order",
    INJ + f" SELECT row_number() OVER (ORDER BY {sql.digest('shuffle', 'id')}) - 1 AS position, {_ID}, {FEATS} FROM inj",
)
def c12(spark, folder):
    shuffled = inject.shuffle_rows(injected(spark, folder).table, "o_orderkey", SEED)
    placed = shuffled.withColumn("_at", F.monotonically_increasing_id())
    numbered, _ = ordered_index(materialize(placed), ["_at"], "position")
    return numbered.select("position", "o_orderkey", *ORDERS.features)


WIDE_TRUTH = ", ".join(f"coalesce(max(label) FILTER (WHERE col = '{c}'), '') AS {c}" for c in ORDERS.features)


@query(
    "c13_cell_truth_wide",
    INJ + f" SELECT i.id AS o_orderkey, {WIDE_TRUTH} FROM inj i LEFT JOIN truth t ON t.id = i.id GROUP BY i.id",
)
def c13(spark, folder):
    return injected(spark, folder).mask


@query("c14_row_truth", INJ + " SELECT id AS o_orderkey, is_dirty, error_types, duplicate_of FROM row_truth")
def c14(spark, folder):
    return injected(spark, folder).row_truth


_SUMMARY_TYPES = sql.values_rows(
    (sql.lit(e), sql.lit("cells" if e in CELL_ERROR_TYPES else "rows")) for e in ERROR_TYPES
)


@query(
    "c15_error_summary",
    INJ + f""" SELECT e.error_type, e.unit, (CASE WHEN e.unit = 'cells'
        THEN (SELECT count(*) FROM truth WHERE label = e.error_type)
        ELSE (SELECT count(*) FROM (SELECT id FROM truth WHERE label = e.error_type GROUP BY id
              HAVING count(*) = {len(ORDERS.features)})) END) AS count
      FROM (VALUES {_SUMMARY_TYPES}) e(error_type, unit)""",
)
def c15(spark, folder):
    return inject.error_summary(injected(spark, folder).cell_truth, ORDERS)


# --- D: rules -------------------------------------------------------------------------------


@query(
    "d1_later_copies_orders",
    INJ + f" SELECT id AS o_orderkey, first_id FROM (SELECT id, min(id) OVER (PARTITION BY {FEATS}) AS first_id FROM inj) WHERE id <> first_id",
)
def d1(spark, folder):
    return copies.later_copies(injected(spark, folder).table, ORDERS.features, "o_orderkey")


@query(
    "d1_repeated_texts",
    "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
)
def d1_texts(spark, folder):
    return copies.later_copies(table(spark, folder, "documents"), ["text"], "doc_id")


@query(
    "d2_unknown_category_customer",
    f"SELECT c_custkey, c_mktsegment NOT IN ({sql.names(CUSTOMER.allowed['c_mktsegment'])}) AS bad FROM customer",
)
def d2(spark, folder):
    df = table(spark, folder, "customer")
    return df.select("c_custkey", rules.is_unknown_category(df, CUSTOMER, "c_mktsegment").alias("bad"))


@query(
    "d3_range_lineitem",
    "SELECT l_returnflag, "
    + ", ".join(f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS {c}" for c, (lo, hi) in LINEITEM.ranges.items())
    + " FROM lineitem GROUP BY l_returnflag",
)
def d3(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.groupBy("l_returnflag").agg(
        *[F.count_if(rules.is_out_of_range(df, LINEITEM, c)).alias(c) for c in LINEITEM.ranges]
    )


@query(
    "d3_range_events",
    "SELECT event_id, coalesce(value < {0} OR value > {1}, false) AS bad FROM events".format(*EVENTS.ranges["value"]),
)
def d3_events(spark, folder):
    df = table(spark, folder, "events")
    return df.select("event_id", rules.is_out_of_range(df, EVENTS, "value").alias("bad"))


@query("d4_missing_cells", RULED + " SELECT id AS o_orderkey, col AS \"column\" FROM said WHERE label = 'missing'")
def d4(spark, folder):
    return rule_cells(spark, folder).filter("label = 'missing'").select("o_orderkey", "column")


_CELL_RULES = ", ".join(f"{sql.rule_label(ORDERS, c, None)} AS {c}" for c in ORDERS.features)


@query("d5_cell_rule_priority", INJ + f" SELECT id AS o_orderkey, {_CELL_RULES} FROM inj")
def d5(spark, folder):
    return rules.cell_rule_mask(injected(spark, folder).table, ORDERS)


_LINE_RULES = ", ".join(f"{sql.rule_label(LINEITEM, c, None)} AS {c}" for c in LINEITEM.features)


@query(
    "d5_cell_rules_lineitem",
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) - 1 AS line_id, {_LINE_RULES} FROM lineitem",
)
def d5_lines(spark, folder):
    return rules.cell_rule_mask(numbered_lines(spark, folder), LINEITEM)


@query("d6_rule_mask", RULED + f" SELECT {_ID}, {FEATS} FROM mask")
def d6(spark, folder):
    return rules.apply_rules(injected(spark, folder).table, ORDERS)


# --- E: profiling and features --------------------------------------------------------------

LINE_NUMBERS = LINEITEM.numbers


@query(
    "e1_medians_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sql.r6(f'quantile_cont({c}, 0.5)')} AS median FROM lineitem" for c in LINE_NUMBERS
    ),
)
def e1(spark, folder):
    df = table(spark, folder, "lineitem")
    found = quantile_frame(df, {c: F.col(c) for c in LINE_NUMBERS}, [0.5])
    return found.select("column", r6("value").alias("median"))


_CELLS_SQL = INJ_STATS + " SELECT * FROM (" + sql.cell_features(ORDERS, "inj", "id AS o_orderkey") + ")"


def orders_cells(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "column features",
        lambda: materialize(rounded(features.column_features(injected(spark, folder).table, ORDERS))),
    )


def _feature_query(name: str, *wanted: str) -> None:
    chosen = ", ".join(wanted)

    @query(name, INJ_STATS + f' SELECT o_orderkey, "column", {chosen} FROM ('
           + sql.cell_features(ORDERS, "inj", "id AS o_orderkey") + ")")
    def run(spark, folder):
        return orders_cells(spark, folder).select("o_orderkey", "column", *wanted)


_feature_query("e2_robust_z", "robust_z")
_feature_query("e3_value_freq", "value_freq")
_feature_query("e4_ratio_to_median", "ratio_to_median")
_feature_query("e5_dist_outside_range", "dist_outside_range")
_feature_query("e6_in_allowed_set", "in_allowed_set")
@query(
    "e7_indexed_labels_customer",
    "SELECT c_name AS key, min(levenshtein(c_name, l)) AS edit_distance FROM (SELECT DISTINCT replace(c_name, '00000', '') AS c_name FROM customer), "
    "(SELECT DISTINCT replace(c_name, '00000', '') || CASE WHEN c_custkey % 4 = 0 THEN 'xyz' ELSE '' END AS l FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1",
)
def e7_indexed(spark, folder):
    """Every name against the names of a tenth of the customers, a quarter of them changed beyond the radius."""
    customers = table(spark, folder, "customer").withColumn("c_name", F.expr("replace(c_name, '00000', '')"))
    chosen = customers.filter("c_custkey % 10 = 0").selectExpr("'c_name' AS column", "c_name || CASE WHEN c_custkey % 4 = 0 THEN 'xyz' ELSE '' END AS label")
    names = customers.selectExpr("'c_name' AS column", "c_name AS key")
    return labels.label_distances(names, chosen).select("key", "edit_distance")


_feature_query("e7_edit_dist_to_allowed", "edit_dist_to_allowed")
_feature_query("e8_has_whitespace", "has_whitespace")
_feature_query("e9_case_mismatch", "case_mismatch")


@query(
    "e3_value_counts_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", n, freq AS value_freq, rows FROM "
        f"(SELECT n, {sql.r6('n::DOUBLE / sum(n * rows) OVER ()')} AS freq, rows FROM "
        f"(SELECT n, count(*) AS rows FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY {c}) GROUP BY n))"
        for c in LINEITEM.features
    ),
)
def e3_lines(spark, folder):
    counts = profile.value_counts(table(spark, folder, "lineitem"), LINEITEM)
    return counts.groupBy("column", "n", r6("value_freq").alias("value_freq")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "e7_text_checks_part",
    "SELECT p_partkey, least(levenshtein(p_type, 'ECONOMY'), levenshtein(p_type, 'LARGER'))::INT AS edits, "
    "regexp_matches(p_name, '^\\s|\\s$') AS spaced, p_type <> lower(p_type) AS cased, "
    "p_type NOT IN ('economy', 'LARGE') AND lower(p_type) IN ('economy', 'large') AS case_only FROM part",
)
def e7_text(spark, folder):
    kind = F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey",
        edit_distance_to(kind, ["ECONOMY", "LARGER"]).alias("edits"),
        has_edge_space(F.col("p_name")).alias("spaced"),
        has_case_mismatch(kind).alias("cased"),
        differs_by_case_only(kind, ["economy", "LARGE"]).alias("case_only"),
    )


_COPY_WINDOWS = (
    "count(*) OVER (PARTITION BY {0}) - 1 AS n_exact_copies, "
    "row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1 AS n_earlier_copies"
)


@query(
    "e10_e11_copy_counts_orders",
    INJ + " SELECT * FROM (SELECT id AS o_orderkey, " + _COPY_WINDOWS.format(FEATS, "id")
    + " FROM inj) WHERE n_exact_copies > 0",
)
def e10(spark, folder):
    return copies.copy_counts(injected(spark, folder).table, ORDERS.features, "o_orderkey")


@query(
    "e10_e11_copy_counts_hot_groups",
    "SELECT * FROM (SELECT event_id, " + _COPY_WINDOWS.format("event_type", "event_id")
    + " FROM events) WHERE n_exact_copies > 0",
)
def e11(spark, folder):
    return copies.copy_counts(table(spark, folder, "events"), ["event_type"], "event_id")


@query(
    "e12_distance_scales",
    INJ_STATS + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sql.r6(f'med_{c}')} AS median, {sql.r6(sql.width(c))} AS width FROM st"
        for c in ORDERS.numbers
    ),
)
def e12(spark, folder):
    scales = profile.distance_scales(injected(spark, folder).table, ORDERS.numbers)
    rows = [(c, round(s.median, 6), round(s.width, 6)) for c, s in scales.items()]
    return spark.createDataFrame(rows, "column string, median double, width double")


_PART = "WITH " + sql.stats(PART, "part") + ",\n" + sql.scaled(PART, "part", "p_partkey") + ",\n" + sql.nearest(PART)


@query(
    "e13_nearest_earlier_part",
    _PART + " SELECT z.id AS p_partkey, round(coalesce(p.distance, (SELECT max(distance) FROM pairs)), 6) AS nearest_earlier_dist "
    "FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e13(spark, folder):
    pairs = materialize(nearest.nearest_pairs(table(spark, folder, "part"), PART))
    return rounded(nearest.nearest_earlier(pairs, "p_partkey"))


_INJ_SCALED = INJ_STATS + ",\n" + sql.scaled(ORDERS, "inj", "id")


def orders_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "pairs",
        lambda: materialize(nearest.nearest_pairs(injected(spark, folder).table, ORDERS)),
    )


@query(
    "e13_nearest_earlier_orders",
    _INJ_SCALED + f", pairs AS MATERIALIZED (SELECT a.id, min({sql.pair_distance(ORDERS)}) AS distance "
    "FROM zs a JOIN zs b ON b.id < a.id GROUP BY a.id) SELECT z.id AS o_orderkey, "
    "round(coalesce(p.distance, (SELECT max(distance) FROM pairs)), 6) AS nearest_earlier_dist "
    "FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e13_orders(spark, folder):
    return rounded(nearest.nearest_earlier(orders_pairs(spark, folder), "o_orderkey"))


@query(
    "e14_matched_pairs_part",
    _PART + " SELECT z.id AS p_partkey, p.partner, round(p.distance, 6) AS distance FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e14(spark, folder):
    return rounded(nearest.nearest_pairs(table(spark, folder, "part"), PART))


@query(
    "e14_matched_pairs_in_radius",
    _INJ_SCALED + ",\n"
    + sql.nearest(ORDERS, " AND abs(a.z_o_totalprice - b.z_o_totalprice) <= 0.03 AND d <= 0.02")
    + " SELECT z.id AS o_orderkey, p.partner, round(p.distance, 6) AS distance FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e14_radius(spark, folder):
    return rounded(nearest.nearest_pairs(injected(spark, folder).table, ORDERS, within=0.02))


def orders_keyed(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "keyed pairs",
        lambda: materialize(keyed.keyed_pairs(injected(spark, folder).table, ORDERS)),
    )


_INJ_KEYED = _INJ_SCALED + ",\n" + sql.keyed_pairs(ORDERS)


@query(
    "e14_keyed_pairs_orders",
    _INJ_KEYED + " SELECT z.id AS o_orderkey, p.partner, p.distance "
    "FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e14_keyed(spark, folder):
    return orders_keyed(spark, folder)


@query(
    "e14_complete_pairs_orders",
    _INJ_SCALED + ",\n" + sql.nearest_of_many(ORDERS) + " SELECT z.id AS o_orderkey, p.partner, p.distance FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e14_complete(spark, folder):
    return once(spark, folder, "complete pairs", lambda: materialize(complete.complete_pairs(injected(spark, folder).table, ORDERS)))


@query(
    "e13_keyed_distances_orders",
    _INJ_KEYED + " SELECT z.id AS o_orderkey, p.distance AS nearest_earlier_dist FROM zs z LEFT JOIN pairs p ON p.id = z.id",
)
def e13_keyed(spark, folder):
    return nearest.nearest_earlier(orders_keyed(spark, folder), "o_orderkey", complete=False)


_INJ_NEAREST = _INJ_SCALED + ",\n" + sql.nearest_of_many(ORDERS)
_ROW_FEATURES = (
    "rowf AS MATERIALIZED (SELECT i.id, " + _COPY_WINDOWS.format(FEATS, "i.id") + ", "
    "coalesce(p.distance, (SELECT max(distance) FROM pairs))::DOUBLE AS nearest_earlier_dist "
    "FROM inj i LEFT JOIN pairs p ON p.id = i.id)"
)


@query(
    "e10_e13_row_features_orders",
    _INJ_NEAREST + ",\n" + _ROW_FEATURES + " SELECT id AS o_orderkey, n_exact_copies, n_earlier_copies, nearest_earlier_dist FROM rowf",
)
def e10_rows(spark, folder):
    return features.row_features(injected(spark, folder).table, ORDERS)


_ALL_CELLS = ", ".join(f"(c.\"column\" = '{c}')::INT AS col_{c}" for c in ORDERS.features)


@query(
    "e15_full_cell_table_orders",
    _INJ_NEAREST + ",\n" + _ROW_FEATURES
    + " SELECT c.*, r.n_exact_copies, r.n_earlier_copies, r.nearest_earlier_dist, " + _ALL_CELLS
    + ", coalesce(t.label, 'clean') AS label FROM (" + sql.cell_features(ORDERS, "inj", "id AS o_orderkey") + ") c "
    "JOIN rowf r ON r.id = c.o_orderkey LEFT JOIN truth t ON t.id = c.o_orderkey AND t.col = c.\"column\"",
)
def e15_full(spark, folder):
    found = labelled_features(spark, folder)
    # This distance is a multiple of 1e-9 already, and rounding twice would differ at halves.
    return rounded(found.withColumn("nearest_earlier_dist", F.col("nearest_earlier_dist").cast("string"))).withColumn(
        "nearest_earlier_dist", F.col("nearest_earlier_dist").cast("double")
    )


_PART_CELLS = "WITH " + sql.stats(PART, "part")


@query("e15_cell_table_part", _PART_CELLS + " SELECT * FROM (" + sql.cell_features(PART, "part", "p_partkey") + ")")
def e15(spark, folder):
    return rounded(features.column_features(table(spark, folder, "part"), PART))


@query("e15_cell_table_orders", _CELLS_SQL)
def e15_orders(spark, folder):
    return rounded(features.column_features(injected(spark, folder).table, ORDERS))


_ONE_HOT = ", ".join(f"(col = '{c}')::INT AS col_{c}" for c in ORDERS.features)


@query(
    "e16_column_one_hot",
    INJ + f' SELECT id AS o_orderkey, col AS "column", {_ONE_HOT} FROM (SELECT id, unnest([{sql.names(ORDERS.features)}]) AS col FROM inj)',
)
def e16(spark, folder):
    return labelled_features(spark, folder).select(
        "o_orderkey", "column", *[f"col_{c}" for c in ORDERS.features]
    )


@query(
    "e17_cell_labels",
    INJ + ' SELECT c.id AS o_orderkey, c.col AS "column", coalesce(t.label, \'clean\') AS label FROM '
    f"(SELECT id, unnest([{sql.names(ORDERS.features)}]) AS col FROM inj) c LEFT JOIN truth t ON t.id = c.id AND t.col = c.col",
)
def e17(spark, folder):
    found = injected(spark, folder)
    every = cells.all_cells(found.table, "o_orderkey", ORDERS.features)
    return features.cell_labels(every, found.cell_truth, ORDERS)


# --- F: learned detectors -------------------------------------------------------------------


def orders_matrix(spark: SparkSession, folder: str) -> tuple[iforest.RowMatrix, DataFrame]:
    found = injected(spark, folder).table
    matrix = once(spark, folder, "matrix", lambda: iforest.fit_matrix(found, ORDERS))
    return matrix, matrix.apply(found)


def _iqr_width(c: str) -> str:
    return f"CASE WHEN iqr_{c} > 0 THEN iqr_{c} ELSE 1.0 END"


@query(
    "f1_row_matrix_numbers",
    INJ_STATS + " SELECT id AS o_orderkey, "
    + ", ".join(f"{sql.r6(f'(coalesce({c}, med_{c}) - med_{c}) / ({_iqr_width(c)})')} AS x_{c}" for c in ORDERS.numbers)
    + " FROM inj, st",
)
def f1(spark, folder):
    _, rows = orders_matrix(spark, folder)
    return rounded(rows.select("o_orderkey", *[f"x_{c}" for c in ORDERS.numbers]))


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM inj WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "f2_row_matrix_one_hot",
    INJ + " " + " UNION ALL ".join(
        f"SELECT id AS o_orderkey, '{c}' AS \"column\", coalesce({c}, {_mode(c)}) AS value FROM inj" for c in ORDERS.categories
    ),
)
def f2(spark, folder):
    matrix, rows = orders_matrix(spark, folder)
    return iforest.one_hot_cells(rows, matrix)


@query(
    "f3_row_matrix_missing",
    INJ + " SELECT id AS o_orderkey, " + ", ".join(f"({c} IS NULL)::INT::DOUBLE AS miss_{c}" for c in ORDERS.features) + " FROM inj",
)
def f3(spark, folder):
    _, rows = orders_matrix(spark, folder)
    return rows.select("o_orderkey", *[f"miss_{c}" for c in ORDERS.features])


_FIELDS = len(ORDERS.numbers) + len(ORDERS.features)
_HOT = " UNION ALL ".join(f"SELECT id, {i} AS c, coalesce({c}, {_mode(c)}) AS value FROM inj" for i, c in enumerate(ORDERS.categories))


@query(
    "f2_f3_sparse_rows",
    INJ_STATS + f""", hot AS MATERIALIZED ({_HOT}),
    words AS (SELECT c, value, row_number() OVER (ORDER BY c, count(*) DESC, value) - 1 AS place FROM hot GROUP BY c, value)
    SELECT id AS o_orderkey, (place + {_FIELDS})::INT AS place, 1.0::DOUBLE AS value FROM hot JOIN words USING (c, value) UNION ALL """
    + " UNION ALL ".join(
        f"SELECT id, {i}, {sql.r6(f'(coalesce({c}, med_{c}) - med_{c}) / ({_iqr_width(c)})')} FROM inj, st WHERE coalesce({c}, med_{c}) <> med_{c}"
        for i, c in enumerate(ORDERS.numbers)
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT id, {len(ORDERS.numbers) + i}, 1.0 FROM inj WHERE {c} IS NULL" for i, c in enumerate(ORDERS.features)),
)
def f2_f3(spark, folder):
    matrix, rows = orders_matrix(spark, folder)
    entries, _ = vectors.sparse_entries(rows, matrix)
    pairs = entries.select("o_orderkey", F.explode(F.arrays_zip("indices", "values")).alias("x"))
    return rounded(pairs.select("o_orderkey", F.col("x.indices").alias("place"), F.col("x.values").alias("value")))


def row_forest(spark: SparkSession, folder: str) -> iforest.IsolationForest:
    return once(
        spark, folder, "row forest",
        lambda: iforest.fit_isolation_forest(injected(spark, folder).table, ORDERS, seed=SEED),
    )


_TREES, _PER_TREE = iforest.TREES, iforest.ROWS_PER_TREE


@query(
    "f4_tree_samples",
    INJ + f" SELECT tree, id AS o_orderkey FROM (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY d, id) AS rn FROM ("
    f"SELECT id, t::INT AS tree, (a + t * b) % {iforest.DRAW_RANGE} AS d FROM (SELECT id, ('0x' || substr(m, 1, 12))::BIGINT AS a, "
    f"('0x' || substr(m, 13, 12))::BIGINT AS b FROM (SELECT id, {sql.digest('tree', 'id')} AS m FROM inj)), range({_TREES}) x(t))) "
    f"WHERE rn <= least({_PER_TREE}, (SELECT count(*) FROM inj))",
)
def f4_samples(spark, folder):
    _, rows = orders_matrix(spark, folder)
    size = rows.count()
    found = iforest._tree_samples(rows, "o_orderkey", size, _TREES, min(_PER_TREE, size), SEED)
    return found.select("tree", "o_orderkey")


@query(
    "f4_isolation_forest_shape",
    INJ + f" SELECT t::INT AS tree, least({_PER_TREE}, (SELECT count(*) FROM inj))::BIGINT AS rows, 1::BIGINT AS leaves_less_inner, true AS shallow "
    f"FROM range({_TREES}) a(t)",
)
def f4_shape(spark, folder):
    """Every tree is binary, no deeper than its limit, and its leaves hold its whole sample."""
    found = row_forest(spark, folder)
    nodes = spark.createDataFrame(
        found.nodes.assign(item=found.nodes["item"].astype(object)).fillna({"field": ""})[["tree", "node", "left", "right", "field"]],
        "tree int, node int, left int, right int, field string",
    )
    leaf = F.col("left") < 0
    sizes = leaf_sizes(spark, folder)
    limit = math.ceil(math.log2(max(found.rows_per_tree, 2)))
    counted = nodes.groupBy("tree").agg((F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_less_inner"))
    return counted.join(sizes, "tree").select("tree", "rows", "leaves_less_inner", (F.col("depth") <= limit).alias("shallow"))


def leaf_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(tree, rows, depth): the sample rows that reach a leaf, and the deepest leaf, by walking the nodes."""
    found = row_forest(spark, folder)
    matrix, rows = orders_matrix(spark, folder)
    size = rows.count()
    samples = iforest._tree_samples(rows, "o_orderkey", size, _TREES, found.rows_per_tree, SEED)
    nodes = {t: g.to_dict("records") for t, g in found.nodes.sort_values("node").groupby("tree")}
    numeric = set(matrix.numeric_fields)

    def walk(group):
        tree = nodes[int(group["tree"].iloc[0])]
        deepest = 0
        for row in group.to_dict("records"):
            node, depth = tree[0], 0
            while node["left"] >= 0:
                value = row[node["field"]]
                right = value > node["split"] if node["field"] in numeric else value == node["item"]
                node, depth = tree[node["right" if right else "left"]], depth + 1
            deepest = max(deepest, depth)
        return pd.DataFrame([(int(group["tree"].iloc[0]), len(group), deepest)], columns=["tree", "rows", "depth"])

    return samples.groupBy("tree").applyInPandas(walk, "tree int, rows bigint, depth int")


def row_scores(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "row scores",
        lambda: materialize(row_forest(spark, folder).score(injected(spark, folder).table)),
    )


@query("f5_isolation_forest_scores")
def f5(spark, folder):
    return rounded(row_scores(spark, folder))


_PATHS = [
    "CASE WHEN x > 1.0 THEN CASE WHEN s = 'P' THEN 5.5 ELSE 3.0 END ELSE 1.25 END",
    "CASE WHEN miss > 0.5 THEN 1.0 ELSE 4.0 END",
]


@query(
    "f5_scores_of_given_trees",
    INJ_STATS + f""" SELECT id AS o_orderkey, round(pow(2.0, -(({') + ('.join(_PATHS)})) / 2.0 / {iforest.average_path(256)!r}), 6) AS score
      FROM (SELECT id, (coalesce(o_totalprice, med_o_totalprice) - med_o_totalprice) / ({_iqr_width('o_totalprice')}) AS x,
            (o_custkey IS NULL)::INT AS miss, coalesce(o_orderstatus, {_mode('o_orderstatus')}) AS s FROM inj, st)""",
)
def f5_given(spark, folder):
    """The scorer on two trees that are written down here."""
    matrix, _ = orders_matrix(spark, folder)
    rows = [
        (0, 0, 1, 2, "x_o_totalprice", 1.0, None, 0.0), (0, 1, -1, -1, None, None, None, 1.25),
        (0, 2, 3, 4, "cat_o_orderstatus", None, "P", 0.0), (0, 3, -1, -1, None, None, None, 3.0),
        (0, 4, -1, -1, None, None, None, 5.5), (1, 0, 1, 2, "miss_o_custkey", 0.5, None, 0.0),
        (1, 1, -1, -1, None, None, None, 4.0), (1, 2, -1, -1, None, None, None, 1.0),
    ]
    nodes = pd.DataFrame(rows, columns=["tree", "node", "left", "right", "field", "split", "item", "path"])
    return rounded(iforest.IsolationForest(matrix, nodes, 256).score(injected(spark, folder).table))


@query(
    "f6_review_budget_events",
    "SELECT event_id, value > (SELECT quantile_cont(value, 0.9) FROM events) AS flagged FROM events",
)
def f6(spark, folder):
    scores = table(spark, folder, "events").select("event_id", F.col("value").alias("score"))
    return iforest.flag_most_anomalous(scores, 0.10).select("event_id", "flagged")


@query(
    "f7_split_by_record",
    "SELECT o_orderkey, CASE WHEN rn <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS side FROM (SELECT o_orderkey, "
    f"row_number() OVER (ORDER BY {sql.digest('split', 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM orders)",
)
def f7(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    sides = split.split_by_record(orders, "o_orderkey", 0.3, SEED)
    return sides.train(orders).withColumn("side", F.lit("train")).unionByName(
        sides.test(orders).withColumn("side", F.lit("test"))
    )


@query(
    "f8_balanced_weights",
    f"SELECT event_type, {sql.r6('sum(n) OVER () / (count(*) OVER () * n)::DOUBLE')} AS weight FROM "
    "(SELECT event_type, count(*) AS n FROM events GROUP BY event_type)",
)
def f8(spark, folder):
    return rounded(forest.balanced_weights(table(spark, folder, "events"), "event_type"))


def cell_forest(spark: SparkSession, folder: str) -> tuple[forest.CellForest, DataFrame]:
    def build():
        labelled = labelled_features(spark, folder)
        sides = split.split_by_record(injected(spark, folder).table, "o_orderkey", 0.3, SEED)
        # One feature decides this label, so what a sound forest says about unseen records is known.
        easy = labelled.withColumn("label", F.when(F.col("is_null") == 1, "missing").otherwise(CLEAN))
        model = forest.train_forest(sides.train(easy), ORDERS)
        return model, materialize(model.predict(sides.test(labelled)))

    return once(spark, folder, "cell forest", build)


def _test_ids(seed: int = SEED) -> str:
    return (
        f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {sql.digest('split', 'id', seed=seed)}) AS rn, count(*) OVER () AS n FROM inj) "
        "WHERE rn <= ceil(0.3::DOUBLE * n)"
    )


_TEST_IDS = _test_ids()
_GONE = f"SELECT id, col FROM pick_missing WHERE id IN ({_TEST_IDS})"


@query("f9_f10_cell_forest_predictions", INJ + f" SELECT id AS o_orderkey, col AS \"column\", 'missing' AS label FROM ({_GONE})")
def f9(spark, folder):
    return cell_forest(spark, folder)[1]


_GONE_MASK = ", ".join(f"coalesce(max('missing') FILTER (WHERE col = '{c}'), '') AS {c}" for c in ORDERS.features)


@query(
    "f11_predictions_to_mask",
    INJ + f" SELECT i.id AS o_orderkey, {_GONE_MASK} FROM inj i LEFT JOIN ({_GONE}) s ON s.id = i.id GROUP BY i.id",
)
def f11(spark, folder):
    return cells.wide_mask(cell_forest(spark, folder)[1], injected(spark, folder).table, ORDERS)


@query(
    "f12_feature_importances",
    "SELECT unnest([" + sql.names(features.feature_names(ORDERS)) + "]) AS feature, 1.0::DOUBLE AS total, true AS ordered",
)
def f12(spark, folder):
    """Every feature is named once; the weights are in falling order and add up to one."""
    names = features.feature_names(ORDERS)
    found = cell_forest(spark, folder)[0].importances(top=len(names)).collect()
    weights = [r["importance"] for r in found]
    ordered = weights == sorted(weights, reverse=True) and min(weights) >= 0
    return spark.createDataFrame(
        [(r["feature"], round(sum(weights), 6), ordered) for r in found], "feature string, total double, ordered boolean"
    )


# --- G: scoring -----------------------------------------------------------------------------


@query("g1_majority_labels", SCORED + " SELECT id AS o_orderkey, label FROM maj_s")
def g1(spark, folder):
    return score.majority_labels(rule_cells(spark, folder), ORDERS)


@query(
    "g2_binary_scores",
    "WITH c AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS s, count(*) FILTER (WHERE quality = 0) AS p, "
    "count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS h FROM labels JOIN documents USING (doc_id) GROUP BY lang) "
    f"SELECT lang, {sql.r6('CASE WHEN p > 0 THEN h::DOUBLE / p ELSE 0 END')} AS precision, "
    f"{sql.r6('CASE WHEN s > 0 THEN h::DOUBLE / s ELSE 0 END')} AS recall, "
    f"{sql.r6('CASE WHEN s + p > 0 THEN 2.0::DOUBLE * h / (s + p) ELSE 0 END')} AS f1 FROM c",
)
def g2(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    counts = joined.groupBy("lang").agg(
        F.count_if(F.col("toxic") == 1).alias("s"),
        F.count_if(F.col("quality") == 0).alias("p"),
        F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("h"),
    )
    scores = score.binary_scores("s", "p", "h")
    return counts.select("lang", *[r6(v).alias(k) for k, v in scores.items()])


def _rounded_scores(inner: str) -> str:
    metrics = ", ".join(f"{sql.r6(m)} AS {m}" for m in score.METRICS)
    return f" SELECT method, error_type, level, support, {metrics} FROM ({inner})"


@query("g3_g5_cell_scores", SCORED + _rounded_scores(sql.type_scores("cell_pairs", CELL_ERROR_TYPES, "cell", RULES)))
def g3(spark, folder):
    truth = injected(spark, folder).cell_truth
    return rounded(score.score_cells(truth, rule_cells(spark, folder), ORDERS, RULES))


@query("g4_g5_duplicate_scores", SCORED + _rounded_scores(sql.type_scores("dup_pairs", ROW_ERROR_TYPES, "row", RULES)))
def g4(spark, folder):
    truth = injected(spark, folder).cell_truth
    return rounded(score.score_duplicates(truth, rule_cells(spark, folder), ORDERS, RULES))


_SAID_IDS = "SELECT id FROM said"


def _auc_sql(rows: str, score_col: str, label_col: str, positive: str) -> str:
    """Rank-sum form with mid-ranks for ties."""
    return (
        f"(SELECT (sum(mid) FILTER (WHERE pos) - p * (p + 1) / 2.0::DOUBLE) / (p * q) FROM (SELECT pos, "
        f"rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid, "
        f"count(*) FILTER (WHERE pos) OVER () ::DOUBLE AS p, count(*) FILTER (WHERE NOT pos) OVER () ::DOUBLE AS q "
        f"FROM (SELECT {score_col} AS s, {label_col} = '{positive}' AS pos FROM {rows})) GROUP BY p, q)"
    )


_PRICED = "(SELECT coalesce(i.o_totalprice, 0) AS price, CASE WHEN r.is_dirty THEN 'y' ELSE 'n' END AS dirty FROM inj i JOIN row_truth r ON r.id = i.id)"


@query(
    "g6_row_scores",
    SCORED + _rounded_scores(sql.row_scores(_SAID_IDS, RULES)).replace(
        " FROM (", f", {sql.r6(_auc_sql(_PRICED, 'price', 'dirty', 'y'))} AS roc_auc FROM (", 1
    ),
)
def g6(spark, folder):
    found = injected(spark, folder)
    prices = found.table.select("o_orderkey", F.coalesce("o_totalprice", F.lit(0.0)).alias("score"))
    return rounded(score.score_rows(found.row_truth, rule_cells(spark, folder), "o_orderkey", RULES, prices))


@query("g7_roc_auc_events", f"SELECT {sql.r6(_auc_sql('events', 'value', 'event_type', 'purchase'))} AS roc_auc")
def g7(spark, folder):
    rows = table(spark, folder, "events").select("value", (F.col("event_type") == "purchase").alias("bought"))
    return rounded(score.roc_auc(rows, "value", "bought"))


@query(
    "g7_roc_auc_with_ties",
    f"SELECT {sql.r6(_auc_sql('lineitem', 'l_quantity', 'l_returnflag', 'R'))} AS roc_auc",
)
def g7_ties(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("back"))
    return rounded(score.roc_auc(rows, "l_quantity", "back"))


_TYPE_ROWS = sql.values_rows([(sql.lit(e),) for e in ERROR_TYPES])


@query(
    "g8_unsupervised_by_type",
    INJ + f""", top AS (SELECT id FROM inj WHERE coalesce(o_totalprice, 0) > 450000)
      SELECT 'Price threshold' AS method, e.error_type, 'row' AS level, count(t.id) AS support,
             NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1,
             {sql.r6("avg(CASE WHEN t.id IS NULL THEN NULL WHEN t.id IN (SELECT id FROM top) THEN 1.0::DOUBLE ELSE 0.0 END)")} AS recall_any
      FROM (VALUES {_TYPE_ROWS}) e(error_type) LEFT JOIN (SELECT DISTINCT id, label FROM truth) t ON t.label = e.error_type
      GROUP BY e.error_type""",
)
def g8(spark, folder):
    found = injected(spark, folder)
    flagged = found.table.filter("o_totalprice > 450000").select("o_orderkey")
    return rounded(score.unsupervised_by_type(found.cell_truth, flagged, ORDERS, "Price threshold"))


def test_side(spark: SparkSession, folder: str) -> DataFrame:
    found = injected(spark, folder).table
    return split.split_by_record(found, "o_orderkey", 0.3, SEED).test(found.select("o_orderkey"))


@query("g9_restrict_to_test_rows", RULED + f' SELECT id AS o_orderkey, col AS "column", label FROM said WHERE id IN ({_TEST_IDS})')
def g9(spark, folder):
    return score.restrict(rule_cells(spark, folder), test_side(spark, folder), "o_orderkey")


_NULLS_ONLY = "Nulls only"


def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two rule detectors on the held-out rows, as one result table."""

    def build() -> DataFrame:
        found, test = injected(spark, folder), test_side(spark, folder)
        truth = score.restrict(found.cell_truth, test, "o_orderkey")
        rows = score.restrict(found.row_truth, test, "o_orderkey")
        said = score.restrict(rule_cells(spark, folder), test, "o_orderkey")
        nulls = said.filter("label = 'missing'")
        return materialize(score.result_table([
            score.score_by_type(truth, said, ORDERS, RULES),
            score.score_by_type(truth, nulls, ORDERS, _NULLS_ONLY),
            score.score_rows(rows, said, "o_orderkey", RULES),
            score.score_rows(rows, nulls, "o_orderkey", _NULLS_ONLY),
        ]))

    return once(spark, folder, "rule results", build)


def _held_out_sql(spec: TableSpec = ORDERS, seed: int = SEED) -> str:
    """CTE result: the same two detectors scored on the held-out rows."""
    ctes = sql.injected(spec, spec.name, seed=seed) + sql.rules(spec) + f""",
test AS MATERIALIZED ({_test_ids(seed)}),
tt AS MATERIALIZED (SELECT * FROM truth WHERE id IN (SELECT id FROM test)),
rt AS MATERIALIZED (SELECT * FROM row_truth WHERE id IN (SELECT id FROM test)),
s1 AS MATERIALIZED (SELECT * FROM said WHERE id IN (SELECT id FROM test)),
s2 AS MATERIALIZED (SELECT * FROM s1 WHERE label = 'missing')"""
    half = f"count(*) * 2 > {len(spec.features)}"
    parts = []
    for s, method in (("s1", RULES), ("s2", _NULLS_ONLY)):
        ctes += f""",
cp_{s} AS MATERIALIZED (SELECT t.label AS t, s.label AS g, s.label IS NOT NULL AS flagged
  FROM tt t FULL JOIN {s} s ON t.id = s.id AND t.col = s.col),
mt_{s} AS MATERIALIZED (SELECT id, label FROM tt GROUP BY id, label HAVING {half}),
mg_{s} AS MATERIALIZED (SELECT id, label FROM {s} GROUP BY id, label HAVING {half}),
dp_{s} AS MATERIALIZED (SELECT t.label AS t, g.label AS g, coalesce(t.id, g.id) IN (SELECT id FROM {s}) AS flagged
  FROM mt_{s} t FULL JOIN mg_{s} g ON t.id = g.id)"""
        parts.append(f"SELECT *, NULL::DOUBLE AS roc_auc FROM ({sql.type_scores(f'cp_{s}', CELL_ERROR_TYPES, 'cell', method)})")
        parts.append(f"SELECT *, NULL::DOUBLE AS roc_auc FROM ({sql.type_scores(f'dp_{s}', ROW_ERROR_TYPES, 'row', method)})")
        parts.append(sql.row_scores(f"SELECT id FROM {s}", method, rows="rt"))
    metrics = ", ".join(f"round_even({m}, 3) AS {m}" for m in score.METRICS)
    return ctes + f""",
result AS MATERIALIZED (SELECT method, error_type, level, support, {metrics}, roc_auc FROM ({' UNION ALL '.join(parts)}))"""


_RESULT = _held_out_sql()


@query("g10_result_table", _RESULT + " SELECT * FROM result")
def g10(spark, folder):
    return rule_results(spark, folder)


_DETECTORS = sql.values_rows(
    [(sql.lit(m), i) for i, m in enumerate((RULES, CELL_FOREST, ROW_FOREST))]
)


@query(
    "g11_experiment",
    _held_out_sql(PART) + f""" SELECT m.method, r.error_type, CASE WHEN m.i = 2 THEN 'row' ELSE r.level END AS level, r.support,
        CASE WHEN m.i = 0 THEN r.precision END AS rule_precision, CASE WHEN m.i = 0 THEN r.recall END AS rule_recall,
        CASE WHEN m.i = 0 THEN r.f1 END AS rule_f1 FROM (VALUES {_DETECTORS}) m(method, i), result r
      WHERE r.method = '{RULES}' AND (m.i < 2 OR r.error_type = 'any_error')
      UNION ALL SELECT '{ROW_FOREST}', e.error_type, 'row', (SELECT count(DISTINCT id) FROM tt WHERE label = e.error_type), NULL, NULL, NULL
      FROM (VALUES {_TYPE_ROWS}) e(error_type)""",
)
def g11(spark, folder):
    """The whole comparison; its rule rows and all supports are known from SQL."""
    results = run_experiment(table(spark, folder, "part"), PART).results
    ruled = F.col("method") == RULES
    return results.select(
        "method", "error_type", "level", "support",
        *[F.when(ruled, F.col(m)).alias(f"rule_{m}") for m in ("precision", "recall", "f1")],
    )


#: Cells that a made-up detector gets right, calls something else, misses, or flags for nothing.
_GUESSED = """(SELECT id, col, CASE WHEN id % 7 = 0 THEN 'category_typo' ELSE label END AS label FROM tt WHERE id % 5 <> 0
  UNION ALL SELECT i.id, '{0}', 'out_of_range' FROM inj i WHERE i.id % 50 = 1 AND i.id IN (SELECT id FROM test)
    AND NOT EXISTS (SELECT 1 FROM tt WHERE tt.id = i.id AND tt.col = '{0}'))"""


def _scored_sql(spec: TableSpec) -> str:
    """The result table of the rules and of two made-up detectors on the held-out rows."""
    half = f"count(*) * 2 > {len(spec.features)}"
    ctes = _held_out_sql(spec) + f""",
g1 AS MATERIALIZED (SELECT * FROM {_GUESSED.format(spec.features[0])}),
cp_g AS MATERIALIZED (SELECT t.label AS t, s.label AS g, s.label IS NOT NULL AS flagged FROM tt t FULL JOIN g1 s ON t.id = s.id AND t.col = s.col),
mg_g AS MATERIALIZED (SELECT id, label FROM g1 GROUP BY id, label HAVING {half}),
dp_g AS MATERIALIZED (SELECT t.label AS t, g.label AS g, coalesce(t.id, g.id) IN (SELECT id FROM g1) AS flagged FROM mt_s1 t FULL JOIN mg_g g ON t.id = g.id),
scores AS MATERIALIZED (SELECT id, ((id * 7919) % 1000) / 1000.0::DOUBLE + CASE WHEN id IN (SELECT id FROM truth) THEN 0.25::DOUBLE ELSE 0.0 END AS score FROM inj),
fl AS MATERIALIZED (SELECT id FROM scores WHERE score > (SELECT quantile_cont(score, 0.9) FROM scores) AND id IN (SELECT id FROM test)),
ranked AS MATERIALIZED (SELECT score AS s, CASE WHEN is_dirty THEN 'y' ELSE 'n' END AS dirty FROM rt JOIN scores USING (id))"""
    metrics = ", ".join(f"round_even({m}, 3) AS {m}" for m in [*score.METRICS, "roc_auc"])
    parts = [
        f"SELECT *, NULL::DOUBLE AS roc_auc FROM ({sql.type_scores('cp_g', CELL_ERROR_TYPES, 'cell', CELL_FOREST)})",
        f"SELECT *, NULL::DOUBLE AS roc_auc FROM ({sql.type_scores('dp_g', ROW_ERROR_TYPES, 'row', CELL_FOREST)})",
        sql.row_scores("SELECT id FROM g1", CELL_FOREST, rows="rt"),
        sql.row_scores("SELECT id FROM fl", ROW_FOREST, _auc_sql("ranked", "s", "dirty", "y"), rows="rt"),
        f"""SELECT '{ROW_FOREST}' AS method, e.error_type, 'row' AS level, count(t.id) AS support, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall,
          NULL::DOUBLE AS f1, avg(CASE WHEN t.id IS NULL THEN NULL WHEN t.id IN (SELECT id FROM fl) THEN 1.0::DOUBLE ELSE 0.0 END) AS recall_any, NULL::DOUBLE AS roc_auc
        FROM (VALUES {_TYPE_ROWS}) e(error_type) LEFT JOIN (SELECT DISTINCT id, label FROM tt) t ON t.label = e.error_type GROUP BY e.error_type""",
    ]
    return ctes + f"""
      SELECT * FROM result WHERE method = '{RULES}' UNION ALL
      SELECT method, error_type, level, support, {metrics} FROM ({' UNION ALL '.join(parts)})"""


@query("g11_scores_of_given_predictions", _scored_sql(ORDERS))
def g11_given(spark, folder):
    """All scores of the comparison, of the rules and of two detectors whose predictions are given."""
    found, first = injected(spark, folder), ORDERS.features[0]
    halves = split.split_by_record(found.table, "o_orderkey", 0.3, SEED)
    truth = found.cell_truth
    right = truth.filter("o_orderkey % 5 <> 0").withColumn("label", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'category_typo' ELSE label END"))
    wrong = found.table.filter("o_orderkey % 50 = 1").select("o_orderkey", F.lit(first).alias("column"), F.lit("out_of_range").alias("label"))
    guessed = right.unionByName(wrong.join(truth, ["o_orderkey", "column"], "left_anti"))
    dirty = truth.select("o_orderkey").distinct().withColumn("extra", F.lit(0.25))
    scores = found.table.select("o_orderkey").join(dirty, "o_orderkey", "left").select(
        "o_orderkey", ((F.col("o_orderkey") * 7919 % 1000) / 1000.0 + F.coalesce("extra", F.lit(0.0))).alias("score")
    )
    flagged = iforest.flag_most_anomalous(materialize(scores), 0.1)
    return score_detectors(found, halves, rule_cells(spark, folder), guessed, flagged)


_SEEDS = range(42, 52)
_SEED_SUMMARY = (
    "sum(support)::BIGINT AS support_total, round_even(avg(precision), 3) AS precision_mean, round_even(avg(recall), 3) AS recall_mean, "
    "round_even(avg(f1), 3) AS f1_mean, round_even(stddev_samp(f1), 3) AS f1_std, "
    "round_even(avg(recall_any), 3) AS recall_any_mean, round_even(avg(roc_auc), 3) AS roc_auc_mean"
)
_BY_SEED = " UNION ALL ".join(
    f"""SELECT * FROM ({_held_out_sql(PART, s)} SELECT m.method, r.error_type, r.support, {', '.join(f'CASE WHEN m.i = 0 THEN r.{k} END AS {k}' for k in score.METRICS)},
        NULL::DOUBLE AS roc_auc FROM (VALUES {_DETECTORS}) m(method, i), result r WHERE r.method = '{RULES}' AND (m.i < 2 OR r.error_type = 'any_error')
      UNION ALL SELECT '{ROW_FOREST}', e.error_type, (SELECT count(DISTINCT id) FROM tt WHERE label = e.error_type), NULL, NULL, NULL, NULL, NULL
      FROM (VALUES {_TYPE_ROWS}) e(error_type))"""
    for s in _SEEDS
)


@query("g12_repeated_experiment", f"WITH runs AS ({_BY_SEED}) SELECT method, error_type, {_SEED_SUMMARY} FROM runs GROUP BY method, error_type")
def g12_seeds(spark, folder):
    """The whole comparison for ten seeds; the rules' rows and all supports are known from SQL."""
    summary = repeat_experiment(table(spark, folder, "part"), PART, _SEEDS, parallel=10, trees=10, depth=8, row_trees=25, search="exact")
    kept = [c for c in summary.columns if c.endswith(("_mean", "_std"))]
    ruled = F.col("method") == RULES
    return summary.select("method", "error_type", "support_total", *[F.when(ruled, F.col(c)).alias(c) for c in kept])


_RULES_BY_SEED = " UNION ALL ".join(
    "SELECT * FROM (" + sql.injected(ORDERS, "orders", seed=s) + sql.rules(ORDERS) + sql.scoring(ORDERS)
    + f" SELECT method, error_type, support, {', '.join(f'round_even({m}, 3) AS {m}' for m in score.METRICS)}, roc_auc FROM ("
    + " UNION ALL ".join(
        f"SELECT *, NULL::DOUBLE AS roc_auc FROM ({sql.type_scores(p, types, level, RULES)})"
        for p, types, level in (("cell_pairs", CELL_ERROR_TYPES, "cell"), ("dup_pairs", ROW_ERROR_TYPES, "row"))
    )
    + f" UNION ALL {sql.row_scores('SELECT id FROM said', RULES)}))"
    for s in _SEEDS
)


@query(
    "g12_repeated_rule_runs",
    f"WITH runs AS ({_RULES_BY_SEED}) SELECT method, error_type, sum(support)::BIGINT AS support_total, "
    "round_even(avg(precision), 3) AS precision_mean, round_even(avg(recall), 3) AS recall_mean, "
    "round_even(avg(f1), 3) AS f1_mean, round_even(stddev_samp(f1), 3) AS f1_std, "
    "round_even(avg(recall_any), 3) AS recall_any_mean, round_even(avg(roc_auc), 3) AS roc_auc_mean "
    "FROM runs GROUP BY method, error_type",
)
def g12_rule_seeds(spark, folder):
    """New errors for every seed, found by the rules, scored and summarised."""
    orders = ORDERS.check_ids(table(spark, folder, "orders"))
    orders = spread_evenly(orders.select(ORDERS.id_col, *ORDERS.record_columns), ORDERS.id_col)

    def planted(seed: int) -> tuple[inject.Injected, DataFrame]:
        found = inject.inject_errors(orders, ORDERS, RATE, seed, checked=True)
        return found, materialize(rules.apply_rules(found.table, ORDERS))

    with ThreadPoolExecutor(5) as pool:
        by_seed = list(pool.map(inheritable_thread_target(spark)(planted), _SEEDS))
    runs = []
    for found, mask in by_seed:
        said = cells.labelled_cells(mask, ORDERS)
        runs.append(score.result_table([
            score.score_by_type(found.cell_truth, said, ORDERS, RULES),
            score.score_rows(found.row_truth, said, "o_orderkey", RULES),
        ]))
    return score.summarize_runs(reduce(DataFrame.unionByName, runs))


_RUNS = (
    "SELECT l_returnflag AS method, l_linestatus AS error_type, l_linenumber AS seed, count(*) AS support, "
    "round(avg(l_discount), 3) AS precision, round(avg(l_tax), 3) AS recall, round(avg(l_quantity), 3) AS f1, "
    "CASE WHEN l_linenumber > 2 THEN round(max(l_discount), 3) END AS recall_any, CAST(NULL AS DOUBLE) AS roc_auc "
    "FROM {0} GROUP BY l_returnflag, l_linestatus, l_linenumber"
)


@query(
    "g12_summary_of_runs",
    f"WITH runs AS ({_RUNS.format('lineitem')}) SELECT method, error_type, sum(support)::BIGINT AS support_total, "
    "round_even(avg(precision), 3) AS precision_mean, round_even(avg(recall), 3) AS recall_mean, "
    "round_even(avg(f1), 3) AS f1_mean, round_even(stddev_samp(f1), 3) AS f1_std, "
    "round_even(avg(recall_any), 3) AS recall_any_mean, round_even(avg(roc_auc), 3) AS roc_auc_mean "
    "FROM runs GROUP BY method, error_type",
)
def g12(spark, folder):
    runs = spark.sql(_RUNS.format("{lines}"), lines=table(spark, folder, "lineitem"))
    return score.summarize_runs(runs)


_METHODS = [RULES, _NULLS_ONLY]


@query(
    "g13_comparison_table",
    _RESULT + " SELECT error_type, max(support) AS support, "
    + ", ".join(f"max({k}) FILTER (WHERE method = '{m}') AS \"{m}:{k}\"" for m in _METHODS for k in score.METRICS)
    + " FROM result WHERE error_type <> 'any_error' GROUP BY error_type",
)
def g13(spark, folder):
    return score.comparison_table(rule_results(spark, folder), _METHODS)


@query(
    "g14_chart_rows",
    _RESULT + " SELECT error_type, method, 'recall_mean' AS metric, recall AS value FROM result WHERE error_type <> 'any_error' "
    "UNION ALL SELECT error_type, method, 'f1_mean', f1 FROM result WHERE error_type <> 'any_error'",
)
def g14(spark, folder):
    return score.chart_rows(score.summarize_runs(rule_results(spark, folder)), _METHODS)


# --- H: exploration -------------------------------------------------------------------------


@query(
    "h1_label_crosstab",
    SCORED + f""" SELECT truth, guess, count(*) AS n FROM (
        SELECT coalesce(t.label, 'clean') AS truth, coalesce(s.label, 'clean') AS guess
        FROM (SELECT id, unnest([{sql.names(ORDERS.features)}]) AS col FROM inj) c
        LEFT JOIN truth t ON t.id = c.id AND t.col = c.col LEFT JOIN said s ON s.id = c.id AND s.col = c.col)
      GROUP BY truth, guess""",
)
def h1(spark, folder):
    found = injected(spark, folder)
    return score.label_crosstab(found.cell_truth, rule_cells(spark, folder), found.table, ORDERS)


def _summary_sql(c: str, source: str) -> str:
    parts = {
        "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "q25": f"quantile_cont({c}, 0.25)",
        "q50": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})",
    }
    rounded_parts = ", ".join(f"round_even({v}::DOUBLE, 1) AS {k}" for k, v in parts.items())
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, {rounded_parts} FROM {source}"


@query("h2_summary_lineitem", " UNION ALL ".join(_summary_sql(c, "lineitem") for c in LINE_NUMBERS))
def h2(spark, folder):
    return profile.summary(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "h3_flag_crosstab",
    RULED + " SELECT is_dirty, id IN (SELECT id FROM said) AS flagged, count(*) AS n FROM row_truth GROUP BY 1, 2",
)
def h3(spark, folder):
    return score.flag_crosstab(injected(spark, folder).row_truth, rule_cells(spark, folder), "o_orderkey")


@query(
    "h4_first_dirty_examples",
    INJ + f", wide AS (SELECT i.id, {WIDE_TRUTH} FROM inj i JOIN truth t ON t.id = i.id GROUP BY i.id ORDER BY i.id LIMIT 6) "
    "SELECT i.id AS o_orderkey, " + ", ".join(f"i.{c}" for c in ORDERS.features) + ", "
    + ", ".join(f"w.{c} AS truth_{c}" for c in ORDERS.features) + " FROM wide w JOIN inj i ON i.id = w.id",
)
def h4(spark, folder):
    found = injected(spark, folder)
    return score.dirty_examples(found.table, found.mask, "o_orderkey", 6)


@query(
    "h5_leakage_check",
    "SELECT (SELECT count(*) FROM orders) - t AS train, t AS test, 0::BIGINT AS shared, t AS planted "
    "FROM (SELECT ceil(0.3::DOUBLE * count(*))::BIGINT AS t FROM orders)",
)
def h5(spark, folder):
    """Sizes of the sides and of what they share; the last column shares one side on purpose."""
    orders = table(spark, folder, "orders")
    sides = split.split_by_record(orders, "o_orderkey", 0.3, SEED)
    train, test = sides.train(orders), sides.test(orders)
    counts = (
        train.count(), test.count(), split.shared_records(train, test, "o_orderkey").count(),
        split.shared_records(orders, test, "o_orderkey").count(),
    )
    return spark.createDataFrame([counts], "train bigint, test bigint, shared bigint, planted bigint")


@query("h6_same_rows_twice", INJ + " SELECT (SELECT count(*) FROM inj) AS n, 0::BIGINT AS tables, 0::BIGINT AS scores")
def h6(spark, folder):
    """Rows that differ when the table is corrupted, and the row forest fitted and applied, once more."""
    again = inject.inject_errors(table(spark, folder, "orders").repartition(5), ORDERS, RATE, SEED).table
    scores = iforest.fit_isolation_forest(again, ORDERS, seed=SEED).score(again.repartition(3))
    first = injected(spark, folder).table
    counts = (
        first.count(), score.same_rows(first, again).count(),
        score.same_rows(rounded(row_scores(spark, folder)), rounded(scores)).count(),
    )
    return spark.createDataFrame([counts], "n bigint, tables bigint, scores bigint")
