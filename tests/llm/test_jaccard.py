import random

import numpy as np
import pytest

from tests.llm import brute
from veritab.llm import jaccard
from veritab.llm.components import components

ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, "one two three four"), (9008, "a b c d e"),
       (9009, "A  b\tc\nd e"), (9010, "é b c d e f"), (None, "a b c d e"), (None, "nobody else says this at all"), (9004, "one"), (9011, "x " * 30000)]


def made(seed, families, copies, passages=3):
    r = random.Random(seed)

    def words(n):
        return [f"w{r.randint(0, 3000)}" for _ in range(n)]

    shared = [words(14) for _ in range(passages)]
    texts = []
    for _ in range(families):
        base = words(r.choice([8, 30, 60, 150]))
        if r.random() < 0.6:
            at = r.randint(0, len(base))
            base[at:at] = r.choice(shared)
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, copies])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = f"n{r.randint(0, 10**6)}"
            texts.append(copy)
    texts += [s + w for s in shared for w in ([], [], ["tail"])]
    r.shuffle(texts)
    return [(100 + i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent,group,copies", [(64, 64, 4), (6, 3, 25), (3, 2, 12)])
def test_equals_all_pairs(spark, monkeypatch, frequent, group, copies):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = made(frequent, 60, copies) + ODD
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, name string, n long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame).collect()), key=repr)
    assert got == sorted(brute.jaccard_components(rows), key=repr)


def test_one_of_each_group_stays(spark):
    rows = made(8, 40, 6) + ODD
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, name string")
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    want = sorted(((i, t) for (i, t), (_, _, c) in zip(rows, brute.jaccard_components(rows)) if i == c), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want


def test_small_tables_take_few_tasks(spark):
    least = 2 * spark.sparkContext.defaultParallelism
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": str(5 * least), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components(spark.range(3000).selectExpr("id * 5 AS a", "id * 5 + 1 + id % 3 AS b"))
        assert len(found.inputFiles()) <= least
        assert {(r["id"], r["component"]) for r in found.collect()} == {(5 * i + j, 5 * i) for i in range(3000) for j in (0, 1 + i % 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(frame).collect() == []


def test_shingle_sets_match_plain_counting():
    rows = made(1, 20, 3) + ODD
    texts = [t or "" for _, t in rows]
    token, bounds = jaccard.shingle_sets(texts)
    assert np.diff(bounds).tolist() == [len(brute.shingles(t)) for t in texts]
    names = jaccard.set_names(token, bounds)
    same = {}
    for t, n in zip(texts, names.tolist()):
        assert same.setdefault(brute.shingles(t), n) == n
    assert len(set(same.values())) == len(same)
