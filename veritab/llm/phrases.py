"""Phrases whose words stand together more often than their parts explain.

Method: counting quotient filters. Words that occur often enough get ids; every run of ids within a
piece of text is packed into one number, permuted, and counted in its shard's filter, which keeps
quotient and whole remainder, so counts are exact. Filters are cut into ranges of quotients and the
sorted filters of all shards are merged range by range. The permutation spreads the keys evenly, and a
phrase takes one slot per shard however often it occurs, so no range is hot.

A phrase as frequent as asked for has only words at least as frequent, so rarer words need no id: runs
break there, and no candidate is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.llm.quotient import QuotientFilter, half_width, packed_words, permuted, restored, unpacked_words
from veritab.llm.shards import global_stream, over_shards, shard_texts, with_ids, word_counts
from veritab.session import discard, materialize

#: What ends a piece, and what a word is, by the contract.
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD = rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]"
#: Grams of one length that a range of quotients is laid out for, over all shards.
RANGE_GRAMS = 4_000_000


def _shard_filters(max_words: int, bits: int, range_bits: int):
    def run(row: dict, words: dict) -> pa.Table:
        n, part, data = [], [], []
        stream = global_stream(row, words, -1) if row else np.zeros(0, np.int64)
        whole = stream >= 0
        for size in range(2, max_words + 1):
            starts = len(stream) - size + 1
            if starts < 1:
                break
            inside = np.flatnonzero(np.logical_and.reduce([whole[k : k + starts] for k in range(size)]))
            half = half_width(size, bits)
            keys = permuted(*packed_words([stream[inside + k] for k in range(size)], bits), half)
            used = min(range_bits, half)
            for number, own in QuotientFilter.of(half, *keys).ranges(used):
                n.append(size)
                part.append(number)
                data.append(own.to_bytes(used))
        return pa.table({"n": pa.array(n, pa.int32()), "part": pa.array(part, pa.int64()), "filter": pa.array(data, pa.binary())})

    return run


def _merge_filters(least: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        size, part = table["n"][0].as_py(), table["part"][0].as_py()
        # Pairs of filters first, so that what is held twice is no more than one level of the tree.
        level = [QuotientFilter.from_bytes(data.as_py(), part) for data in table["filter"]]
        while len(level) > 1:
            level = [QuotientFilter.merged(level[i : i + 2]) for i in range(0, len(level), 2)]
        often = level[0].at_least(least)
        ids = unpacked_words(*restored(often.high, often.low, often.half), size, bits)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(often) + 1) * size, pa.int32()), pa.array(np.stack(ids, axis=1).ravel() if len(often) else np.zeros(0, np.int64))
        )
        return pa.table({"n": pa.array(np.full(len(often), size, np.int32)), "key": lists, "f": pa.array(often.counts)})

    return run


class Grams:
    """Counts of all grams of 1 to ``max_words`` words that occur at least ``least`` times in a language.

    ``words``: (key, f, phrase, lang) of single words; ``longer``: (n, key, f); ``key`` is the list of
    word ids. ``totals``: (lang, n), all word occurrences.
    """

    def __init__(self, documents: DataFrame, text_col: str, lang_col: str, max_words: int, least: int):
        spark = documents.sparkSession
        lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
        # A word holds no tab, so the last one ends the language.
        shards = materialize(shard_texts(documents, F.col(text_col), WORD, breaks=BREAKS, prefix=F.concat(lang, F.lit("\t"))))
        counts = materialize(word_counts(shards).withColumn("word", F.col("word").cast("string")))
        phrase = F.substring_index("word", "\t", -1)
        own = F.expr("left(word, length(word) - length(substring_index(word, '\t', -1)) - 1)")
        self.totals = materialize(counts.groupBy(own.alias("lang")).agg(F.sum("count").alias("n")))
        words = materialize(with_ids(counts.filter(F.col("count") >= least)))
        known = words.agg(F.max("id"), F.sum("count")).first()
        bits = max(1, int(known[0] or 0).bit_length())
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(known[1] or 0) // RANGE_GRAMS)
        range_bits = (ranges - 1).bit_length()
        numbered = words.withColumn("word", F.col("word").cast("binary"))
        filters = over_shards(shards, numbered, _shard_filters(max_words, bits, range_bits), "n int, part long, filter binary")
        merged = filters.groupBy("n", "part").applyInArrow(_merge_filters(least, bits), "n int, key array<long>, f long")
        self.longer = materialize(merged)
        discard(shards)
        discard(counts)
        self.words = words.select(F.array("id").alias("key"), F.col("count").alias("f"), phrase.alias("phrase"), own.alias("lang"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits; a is at most l and r."""
    wide = [x.cast("decimal(15,0)") for x in (a, left, right)]
    top, bottom = F.lit(1000000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2]
    return F.call_function("div", top, bottom)


def collocations(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = 3,
    least: int = 10,
    covered: int = 50,
    top: int | None = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language, best first.

    A candidate has 2 to ``max_words`` words and occurs a >= ``least`` times within pieces, overlaps
    included. Its score is that of its weakest cut into a first part (l occurrences) and a rest (r). It
    goes if a longer candidate that contains it holds ``covered`` per cent of its occurrences. ``top``
    phrases of each language are listed, all with None. Null texts are empty, a null language is ``und``.
    Repeated rows count as often as they stand there. No documents, no rows. Other columns are not read.
    Counts must stay below 10**15.
    """
    grams = Grams(documents, text_col, lang_col, max_words, least)
    parts = {1: grams.words}
    found = []
    for n in range(2, max_words + 1):
        mine = grams.longer.filter(F.col("n") == n).select("key", F.col("f").alias("a"))
        for k in range(1, n):
            first = parts[k].select(F.col("key").alias("_first"), F.col("f").alias(f"l{k}"), *[F.col(c).alias(f"_{c}") for c in ("phrase", "lang") if k == n - 1])
            rest = parts[n - k].select(F.col("key").alias("_rest"), F.col("f").alias(f"r{k}"), *[F.col("phrase").alias("_last") for _ in range(k == n - 1)])
            mine = mine.withColumn("_first", F.slice("key", 1, k)).join(first, "_first").drop("_first")
            mine = mine.withColumn("_rest", F.slice("key", k + 1, n - k)).join(rest, "_rest").drop("_rest")
        cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
        mine = mine.select(
            "key", F.col("a").alias("f"), F.concat_ws(" ", "_phrase", "_last").alias("phrase"), F.col("_lang").alias("lang"),
            F.array_min(F.array(*cuts)).alias("cut"),
        )
        parts[n] = materialize(mine)
        found.append(parts[n])
    def parts_of(m: int, n: int) -> Column:
        """All runs of n words within a key of m words."""
        return F.transform(F.sequence(F.lit(1), F.lit(m - n + 1)), lambda i: F.slice("key", i, F.lit(n)))

    kept = []
    for n, mine in enumerate(found, 2):
        for m in range(n + 1, max_words + 1):
            above = parts[m].select(F.explode(parts_of(m, n)).alias("key"), "f").groupBy("key").agg(F.max("f").alias("_above"))
            mine = mine.join(above, "key", "left").filter(F.col("_above").isNull() | (100 * F.col("_above") < covered * F.col("f"))).drop("_above")
        kept.append(mine)
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # The first of every share of a language come before its first ones overall.
        share = F.pmod(F.xxhash64("phrase"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        place = F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))
        rows = rows.withColumn("_share", share).withColumn("_place", place).filter(F.col("_place") <= top).drop("_share", "_place")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(grams.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
