"""Reading and writing tables as files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from veritab.functions.numbers import no_nan


def _dialect(missing: str) -> dict[str, object]:
    """What reader and writer must agree on: quotes are doubled, and spaces, line breaks and empty texts stay.

    Spark trims spaces, escapes with a backslash and drops empty texts by default.
    """
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spaces | {"quote": '"', "escape": '"', "nullValue": missing, "emptyValue": '""'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, missing: str = "", multi_line: bool = True
) -> DataFrame:
    """Read CSV with a given schema; ``missing`` is the text that stands for a missing value.

    Declare any column that may hold fractions as DOUBLE: an INT schema silently reads ``145.0``
    as NULL (``read_csv_checked`` tells). With ``multi_line`` a quoted text may hold line breaks, and a file is one
    task's work; without it large files are split, and such texts are not read right.
    """
    reader = spark.read.schema(schema).options(**_dialect(missing) | {"emptyValue": ""}, header=header, multiLine=multi_line)
    return reader.csv(path)


@dataclass(frozen=True)
class CheckedRows:
    """``rows`` have the asked-for schema; ``bad`` has (file, record, reason) of every record that does not fit it."""

    rows: DataFrame
    bad: DataFrame


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, missing: str = "", multi_line: bool = True
) -> CheckedRows:
    """Read CSV and keep apart what does not fit the schema, instead of reading it as NULL.

    A record is bad if it has too few or too many fields, or a text that is not a value of its column's type; the
    reason names the columns. Every record is in exactly one of the two results.
    """
    texts = T.StructType([T.StructField(f"t{i}", T.StringType()) for i in range(len(schema))] + [T.StructField("_broken", T.StringType())])
    options = _dialect(missing) | {"emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    # The header's names would be compared with these, so it is told to be skipped without.
    raw = spark.read.schema(texts).options(**options, header=header, enforceSchema=True, multiLine=multi_line).csv(path)
    raw = raw.withColumn("_file", F.input_file_name())
    typed, wrong = [], []
    for i, f in enumerate(schema):
        value = F.col(f"t{i}").try_cast(f.dataType)
        typed.append(value.alias(f.name))
        wrong.append(F.when(F.col(f"t{i}").isNotNull() & value.isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}")))
    fields = F.lit(f"not {len(schema)} fields")
    reason = F.when(F.col("_broken").isNotNull(), fields).otherwise(F.nullif(F.concat_ws("; ", *wrong), F.lit("")))
    marked = raw.withColumn("_reason", reason)
    text = F.to_csv(F.struct(*[F.col(f"t{i}") for i in range(len(schema))]), {"quote": '"', "escape": '"', "nullValue": missing})
    bad = marked.filter("_reason IS NOT NULL").select(
        F.col("_file").alias("file"), F.coalesce("_broken", text).alias("record"), F.col("_reason").alias("reason")
    )
    return CheckedRows(marked.filter("_reason IS NULL").select(*typed), bad)


def write_csv(df: DataFrame, path: str, header: bool = True, missing: str = "", mode: str = "errorifexists") -> None:
    """Write CSV that ``read_csv`` reads back as it was: edge spaces, quotes, line breaks and empty texts.

    An existing folder is left alone unless ``mode`` says otherwise.
    """
    df.write.mode(mode).options(**_dialect(missing), header=header).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in a fixed order, with NaN normalised to NULL."""
    fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[no_nan(F.col(c)).alias(c) if c in fractional else F.col(c) for c in columns]
    )
