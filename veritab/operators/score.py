"""Precision, recall and F1 of detectors, per error type and per record.

Truth and predictions are long, sparse (id, column, label) cells. A clean cell that was called
clean enters none of the scores, so it is never stored, joined or counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veritab.operators.rank import running_total
from veritab.spec import CELL_ERROR_TYPES, CLEAN, ERROR_TYPES, ROW_ERROR_TYPES, TableSpec

# The column names of the result tables; summaries add _total, _mean and _std.
METRICS = ["precision", "recall", "f1", "recall_any"]
ANY_ERROR = "any_error"
RESULT_COLUMNS = ["method", "error_type", "level", "support", *METRICS, "roc_auc"]


def restrict(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Only the records of ``ids``."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def majority_labels(cells: DataFrame, spec: TableSpec) -> DataFrame:
    """(id, label) of rows of which one label covers more than half of all cells."""
    counts = cells.groupBy(spec.id_col, "label").agg(F.count(F.lit(1)).alias("cells"))
    return counts.filter(F.col("cells") * 2 > len(spec.features)).select(spec.id_col, "label")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def binary_scores(support: str, predicted: str, hits: str) -> dict[str, Column]:
    """Precision, recall and F1 from counts; 0 where a denominator is 0."""
    s, p, h = F.col(support), F.col(predicted), F.col(hits)
    return {"precision": _ratio(h, p), "recall": _ratio(h, s), "f1": _ratio(2 * h, s + p)}


#: Columns of a record that one mask holds.
_MASK_BITS = 63


def label_pairs(truth: DataFrame, guess: DataFrame, on: Sequence[str]) -> DataFrame:
    """(truth, guess) of every unit that carries a label on either side."""
    return truth.withColumnRenamed("label", "truth").join(
        guess.withColumnRenamed("label", "guess"), list(on), "full"
    )


def label_masks(truth: DataFrame, guess: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per record with a label on either side: bit masks of the columns that carry each label.

    ``truth_<type>`` and ``guess_<type>`` are arrays of masks, 63 columns each; ``guess_any`` has all that is flagged.
    Truth and guess meet in this one exchange, in which a task sends a record's masks and not its cells.
    """
    columns = spec.features
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int") - 1
    cells = truth.select(spec.id_col, "column", "label", F.lit(True).alias("_true")).unionByName(
        guess.select(spec.id_col, "column", "label", F.lit(False).alias("_true"))
    )
    placed = cells.withColumn("_place", place).filter("_place >= 0").withColumn("_bit", F.expr(f"shiftleft(1L, _place % {_MASK_BITS})"))
    words = range(-(-len(columns) // _MASK_BITS))

    def mask(condition: Column, name: str) -> Column:
        parts = [F.bit_or(F.when(condition & (F.floor(F.col("_place") / _MASK_BITS) == w), F.col("_bit")).otherwise(F.lit(0).cast("bigint"))) for w in words]
        return F.array(*parts).alias(name)

    wanted = [mask(~F.col("_true"), "guess_any")]
    for e in ERROR_TYPES:
        wanted += [mask(F.col("_true") & (F.col("label") == e), f"truth_{e}"), mask(~F.col("_true") & (F.col("label") == e), f"guess_{e}")]
    return placed.groupBy(spec.id_col).agg(*wanted)


def _bits(masks: Column) -> Column:
    return F.aggregate(masks, F.lit(0).cast("bigint"), lambda total, m: total + F.bit_count(m))


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _scores_of_masks(masks: DataFrame, types: Sequence[str], spec: TableSpec, method: str) -> DataFrame:
    """One row per type, from one aggregate: cells are counted as bits, records by what most of their bits say."""
    half, flagged = len(spec.features), F.col("guess_any")
    counts = []
    for e in types:
        truth, guess = F.col(f"truth_{e}"), F.col(f"guess_{e}")
        if e in CELL_ERROR_TYPES:
            parts = {"support": _bits(truth), "predicted": _bits(guess), "hits": _bits(_both(truth, guess)), "caught": _bits(_both(truth, flagged))}
        else:
            is_true, is_guess = _bits(truth) * 2 > half, _bits(guess) * 2 > half
            flags = {"support": is_true, "predicted": is_guess, "hits": is_true & is_guess, "caught": is_true & (_bits(flagged) > 0)}
            parts = {name: flag.cast("bigint") for name, flag in flags.items()}
        level = "cell" if e in CELL_ERROR_TYPES else "row"
        totals = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(name) for name, c in parts.items()]
        counts.append(F.struct(F.lit(e).alias("error_type"), F.lit(level).alias("level"), *totals))
    counted = masks.agg(F.array(*counts).alias("types")).select(F.explode("types").alias("t")).select("t.*")
    return counted.select(
        F.lit(method).alias("method"),
        "error_type",
        "level",
        "support",
        *[c.alias(n) for n, c in binary_scores("support", "predicted", "hits").items()],
        F.when(F.col("support") > 0, F.col("caught") / F.col("support")).alias("recall_any"),
    )


def score_cells(truth: DataFrame, guess: DataFrame, spec: TableSpec, method: str) -> DataFrame:
    """Scores of the cell error types, one unit per cell."""
    return _scores_of_masks(label_masks(truth, guess, spec), CELL_ERROR_TYPES, spec, method)


def score_duplicates(truth: DataFrame, guess: DataFrame, spec: TableSpec, method: str) -> DataFrame:
    """Scores of the duplicate types, one unit per record, by majority label on both sides."""
    return _scores_of_masks(label_masks(truth, guess, spec), ROW_ERROR_TYPES, spec, method)


def score_by_type(truth: DataFrame, guess: DataFrame, spec: TableSpec, method: str) -> DataFrame:
    """One row per error type, in report order."""
    return _scores_of_masks(label_masks(truth, guess, spec), ERROR_TYPES, spec, method)


def roc_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the chance that a positive outranks a negative, ties counting half.

    Rows are reduced to one per distinct score first; the negatives below each score are a
    bucketed running total. NULL if a class is absent.
    """
    groups = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~F.col(positive)).alias("neg")
    )
    ranked = running_total(groups, "score", "neg", "neg_below")
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    possible = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.when(possible > 0, won / possible).alias("roc_auc"))


def score_rows(
    row_truth: DataFrame, flagged: DataFrame, id_col: str, method: str, score: DataFrame | None = None
) -> DataFrame:
    """"Is this record dirty?" scores of the records of ``row_truth``.

    ``flagged`` holds the ids a method flags, ``score`` its optional (id, score) ranking.
    """
    marks = flagged.select(id_col).distinct().withColumn("flagged", F.lit(True))
    rows = row_truth.select(id_col, "is_dirty").join(marks, id_col, "left")
    hit = F.coalesce("flagged", F.lit(False))
    counts = rows.agg(
        F.count_if("is_dirty").alias("support"),
        F.count_if(hit).alias("predicted"),
        F.count_if(F.col("is_dirty") & hit).alias("hits"),
    )
    scores = binary_scores("support", "predicted", "hits")
    result = counts.select(
        F.lit(method).alias("method"),
        F.lit(ANY_ERROR).alias("error_type"),
        F.lit("row").alias("level"),
        "support",
        *[c.alias(n) for n, c in scores.items()],
        scores["recall"].alias("recall_any"),
    )
    if score is None:
        return result.withColumn("roc_auc", F.lit(None).cast("double"))
    ranked = row_truth.select(id_col, "is_dirty").join(score, id_col)
    area = roc_auc(ranked, "score", "is_dirty").withColumn("method", F.lit(method))
    return result.join(F.broadcast(area), "method")


def unsupervised_by_type(
    truth: DataFrame, flagged: DataFrame, spec: TableSpec, method: str
) -> DataFrame:
    """Share of the records with each error type that an untyped row detector flags."""
    has = truth.select(spec.id_col, "label").distinct()
    marks = flagged.select(spec.id_col).distinct().withColumn("flagged", F.lit(1.0))
    shares = has.join(marks, spec.id_col, "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("flagged", F.lit(0.0))).alias("recall_any")
    )
    types = truth.sparkSession.createDataFrame([(e,) for e in ERROR_TYPES], "error_type string")
    return types.join(shares, types["error_type"] == shares["label"], "left").select(
        F.lit(method).alias("method"),
        "error_type",
        F.lit("row").alias("level"),
        F.coalesce("n", F.lit(0)).alias("support"),
        *[F.lit(None).cast("double").alias(m) for m in METRICS[:3]],
        "recall_any",
    )


def result_table(parts: Sequence[DataFrame], digits: int = 3) -> DataFrame:
    """The parts stacked in order, metrics rounded half-even."""
    rounded = METRICS + ["roc_auc"]
    stacked = None
    for part in parts:
        if "roc_auc" not in part.columns:
            part = part.withColumn("roc_auc", F.lit(None).cast("double"))
        part = part.select(*RESULT_COLUMNS)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.withColumns({m: F.bround(m, digits) for m in rounded})


def summarize_runs(runs: DataFrame, digits: int = 3) -> DataFrame:
    """Support summed, metrics averaged (NULL skipped), F1 deviation, per method and error type."""
    means = [F.bround(F.avg(m), digits).alias(f"{m}_mean") for m in ("precision", "recall", "f1")]
    return runs.groupBy("method", "error_type").agg(
        F.sum("support").alias("support_total"),
        *means,
        F.bround(F.stddev_samp("f1"), digits).alias("f1_std"),
        F.bround(F.avg("recall_any"), digits).alias("recall_any_mean"),
        F.bround(F.avg("roc_auc"), digits).alias("roc_auc_mean"),
    )


def type_position(column: Column) -> Column:
    """Report order of an error type."""
    return F.array_position(F.array(*[F.lit(e) for e in ERROR_TYPES]), column)


def comparison_table(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per error type, one ``method:metric`` column per typed method and metric."""
    typed = results.filter((F.col("error_type") != ANY_ERROR) & F.col("method").isin(*methods))
    return (
        typed.groupBy("error_type")
        .agg(
            F.max("support").alias("support"),
            *[
                F.max(F.when(F.col("method") == m, F.col(k))).alias(f"{m}:{k}")
                for m in methods
                for k in METRICS
            ],
        )
        .orderBy(type_position(F.col("error_type")))
    )


def chart_rows(summary: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Long (error_type, method, metric, value) rows of mean recall and F1, ready to plot."""
    typed = summary.filter((F.col("error_type") != ANY_ERROR) & F.col("method").isin(*methods))
    return typed.unpivot(
        ["error_type", "method"], ["recall_mean", "f1_mean"], "metric", "value"
    ).orderBy(type_position(F.col("error_type")), "method", "metric")


def label_crosstab(truth: DataFrame, guess: DataFrame, ids: DataFrame, spec: TableSpec) -> DataFrame:
    """(truth, guess, n) over all cells, clean ones included.

    Cells that are clean on both sides are counted as all cells less the others, not listed.
    """
    clean = F.lit(CLEAN)
    labelled = (
        label_pairs(truth, guess, [spec.id_col, "column"])
        .groupBy(F.coalesce("truth", clean).alias("truth"), F.coalesce("guess", clean).alias("guess"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = ids.agg((F.count(F.lit(1)) * len(spec.features)).alias("n"))
    rest = every.unionByName(labelled.select((-F.col("n")).alias("n"))).select(
        clean.alias("truth"), clean.alias("guess"), "n"
    )
    return labelled.unionByName(rest).groupBy("truth", "guess").agg(F.sum("n").alias("n"))


def flag_crosstab(row_truth: DataFrame, flagged: DataFrame, id_col: str) -> DataFrame:
    """(is_dirty, flagged, n) over all records."""
    marks = flagged.select(id_col).distinct().withColumn("flagged", F.lit(True))
    rows = row_truth.select(id_col, "is_dirty").join(marks, id_col, "left")
    return rows.groupBy("is_dirty", F.coalesce("flagged", F.lit(False)).alias("flagged")).agg(
        F.count(F.lit(1)).alias("n")
    )


def dirty_examples(table: DataFrame, mask: DataFrame, id_col: str, n: int = 6) -> DataFrame:
    """The first ``n`` dirty records beside the labels of their cells."""
    labels = [c for c in mask.columns if c != id_col]
    found = mask.filter(" OR ".join(f"`{c}` != ''" for c in labels))
    first = found.orderBy(id_col).limit(n)
    renamed = first.select(id_col, *[F.col(c).alias(f"truth_{c}") for c in labels])
    return table.join(F.broadcast(renamed), id_col).orderBy(id_col)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reproducibility check: rows that only one of two runs has; must be empty."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
