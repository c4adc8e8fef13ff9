"""The row matrix as one sparse vector per record, in the form that MLlib takes.

Numbers come first, then the missing flags, then one place for each value of each category column. The vocabulary of these
values is a table of its own, the most frequent value first, so it may have any number of rows: records look
their values up in a join that stays balanced where a value is common.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from veritab.operators.iforest import RowMatrix, one_hot_cells
from veritab.operators.skew import heavy_lookup
from veritab.session import materialize, scratch_path


def vocabulary(rows: DataFrame, matrix: RowMatrix) -> DataFrame:
    """(column, value, n, place): places from 0, column after column, by falling frequency and then by value."""
    counts = materialize(one_hot_cells(rows, matrix).groupBy("column", "value").agg(F.count("*").alias("n")))
    sizes = {r["column"]: r["values"] for r in counts.groupBy("column").agg(F.count("*").alias("values")).collect()}
    start, offset = 0, F.lit(None).cast("bigint")
    for c in matrix.spec.categories:  # one row per column
        offset = F.when(F.col("column") == c, F.lit(start).cast("bigint")).otherwise(offset)
        start += sizes.get(c, 0)
    within = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", offset + F.row_number().over(within) - 1)


def sparse_entries(rows: DataFrame, matrix: RowMatrix) -> tuple[DataFrame, int]:
    """(id, indices, values) of every record, indices rising and values not 0, and the length of the vectors.

    ``rows`` is the matrix applied to a table.
    """
    id_col, fields = matrix.spec.id_col, matrix.numeric_fields
    if not matrix.spec.categories:
        rows, size = rows.withColumn("_places", F.array().cast("array<int>")), 0
    else:
        words = materialize(vocabulary(rows, matrix))
        size = words.count()
        cells = heavy_lookup(one_hot_cells(rows, matrix), words, ["column", "value"], "n", id_col)
        places = cells.groupBy(id_col).agg(F.sort_array(F.collect_list((F.col("place") + len(fields)).cast("int"))).alias("_places"))
        rows = rows.join(places, id_col)
    numbers = F.filter(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(fields)]), lambda x: x["v"] != 0
    )
    ones = F.transform("_places", lambda place: F.lit(1.0))
    return rows.select(
        id_col, F.concat(numbers["i"], F.col("_places")).alias("indices"), F.concat(numbers["v"], ones).alias("values")
    ), len(fields) + size


def row_vectors(df: DataFrame, matrix: RowMatrix, name: str = "features") -> DataFrame:
    """(id, ``name``): the records of ``df`` as sparse vectors.

    A vector is stored as a structure of these four fields; written once, it is read back as a vector, without a
    Python function.
    """
    entries, size = sparse_entries(matrix.apply(df), matrix)
    stored: Column = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    path = scratch_path(df.sparkSession)
    entries.select(matrix.spec.id_col, stored.alias(name)).write.parquet(path)
    schema = StructType([entries.schema[matrix.spec.id_col], StructField(name, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)
