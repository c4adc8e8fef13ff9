"""How far a text is from the nearest of many allowed labels, without comparing it with each.

Method: within ``RADIUS`` edits, deleting some characters of the text and some of the label leaves two texts that differ in
a few places, and these places can be left out of both. So a distance up to the radius is an equal pattern (what
is left and where), found by an equi-join: one edit first, two edits for the keys that are still open. Equal patterns
are the proof, no pairs of keys and labels are listed, and the work grows with the keys plus the labels. Keys that have no
label that near are compared with all labels of their column; blocks of labels and shares of keys meet in an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veritab.session import materialize

RADIUS = 2
#: Longer texts have too many patterns to be worth an index, and are compared directly.
LONGEST = 48
#: From so many labels of a column on the index is used instead of one expression per label.
INDEXED = 64
#: Labels that are compared with a key at once.
_BLOCK = 1024


def _places(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))


def _shorter(text: Column) -> Column:
    """The text with each one character deleted, each once."""
    return F.array_distinct(F.transform(_places(text), lambda i: _without(text, i)))


def _each(texts: Column, change) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, change)))


def _named(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(f"{kind}:"), t))


def _replaced(kind: str, text: Column) -> Column:
    """What stays if one character is replaced, with its place."""
    return F.transform(_places(text), lambda i: F.concat(F.lit(f"{kind}:"), i.cast("string"), F.lit(":"), _without(text, i)))


def _replaced_twice(kind: str, text: Column) -> Column:
    def with_last(q: Column) -> Column:
        earlier = F.when(q > 1, F.sequence(F.lit(1), q - 1)).otherwise(F.array().cast("array<int>"))
        rest = _without(text, q)
        return F.transform(earlier, lambda p: F.concat(F.lit(f"{kind}:"), p.cast("string"), F.lit(":"), q.cast("string"), F.lit(":"), _without(rest, p)))

    return F.flatten(F.transform(_places(text), with_last))


def patterns(text: Column, edits: int, of_key: bool) -> Column:
    """A key and a label have a pattern in common exactly if so many edits, of any kinds, lead from one to the other.

    ``d`` is a character that only the key has, ``i`` one that only the label has, ``r`` a replaced one.
    """
    d, i = ("d", "i") if of_key else ("i", "d")
    if edits == 1:
        return F.concat(_named(d, _shorter(text)), _named(i, F.array(text)), _replaced("r", text))
    return F.concat(
        _named(d + d, _each(_shorter(text), _shorter)),
        _named(i + i, F.array(text)),
        _named("di", _shorter(text)),
        _each(_shorter(text), lambda t: _replaced(d + "r", t)),
        _replaced(i + "r", text),
        _replaced_twice("rr", text),
    )


def _within(keys: DataFrame, labels: DataFrame, edits: int) -> DataFrame:
    """The keys that so many edits lead to a label."""
    if edits == 0:
        return keys.join(labels.withColumnRenamed("label", "key").hint("merge"), ["column", "key"], "left_semi")
    # A label that is longer than this has no key that is indexed within the radius.
    some = labels.filter(F.length("label") <= LONGEST + RADIUS).select("column", F.explode(patterns(F.col("label"), edits, False)).alias("pattern"))
    own = keys.filter(F.length("key") <= LONGEST).select("column", "key", F.explode(patterns(F.col("key"), edits, True)).alias("pattern"))
    # Patterns shrink so much when they are written that they look small enough to be sent everywhere, which they are not.
    return own.join(some.hint("merge"), ["column", "pattern"], "left_semi").select("column", "key").distinct()


def _compared(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Every key with all labels of its column: a share of the keys meets all blocks of labels."""
    shares = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = labels.groupBy("column", F.pmod(F.xxhash64("label"), F.lit(-(-labels.count() // _BLOCK) or 1)).alias("block")).agg(
        F.collect_list("label").alias("labels")
    )
    dealt = blocks.select("column", "labels", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    shared = keys.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"))
    pairs = shared.join(dealt.hint("merge"), ["column", "share"]).select(
        "column", "key", F.array_min(F.transform("labels", lambda label: F.levenshtein(F.col("key"), label))).alias("edit_distance")
    )
    return pairs.groupBy("column", "key").agg(F.min("edit_distance").alias("edit_distance"))


def label_distances(values: DataFrame, allowed: Mapping[str, Sequence[str]] | DataFrame) -> DataFrame:
    """(column, key, edit_distance): fewest edits from each distinct ``key`` of ``values`` to a label of its column.

    ``allowed`` has the labels of each column, as lists or as a table (column, label). 0 for missing and empty keys, and for
    columns without labels.
    """
    if not isinstance(allowed, DataFrame):
        rows = [(c, label) for c, labels in allowed.items() for label in labels]
        allowed = values.sparkSession.createDataFrame(rows, "column string, label string")
    labels = materialize(allowed.select("column", "label").filter("label IS NOT NULL").distinct())
    keys = materialize(values.select("column", "key").distinct())
    some = keys.filter("key IS NOT NULL AND key <> ''").join(F.broadcast(labels.select("column").distinct()), "column")
    found, still_open = None, some
    for edits in range(RADIUS + 1):
        near = materialize(_within(still_open, labels, edits).select("column", "key", F.lit(edits).alias("edit_distance")))
        found = near if found is None else found.unionByName(near)
        still_open = still_open.join(near.hint("merge"), ["column", "key"], "left_anti")
    found = found.unionByName(_compared(still_open, labels))
    # Keys without a distance of their own are missing or empty, or their column has no labels.
    return keys.select("column", "key", F.lit(0).alias("edit_distance")).unionByName(found).groupBy("column", "key").agg(
        F.max("edit_distance").alias("edit_distance")
    )
