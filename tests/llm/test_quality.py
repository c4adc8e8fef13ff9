import itertools
import zlib

import numpy as np
import pyarrow as pa

from veritab.llm import crf


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    sizes = [1, 4, 2, 6, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, transition = r.normal(size=first[-1]) * 2, r.normal(size=(2, 2))
    got, expected = crf.marginals(emission, transition, first, pairs=True)
    pairs = np.zeros((2, 2))
    for a, n in zip(first, sizes):
        total, good, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(emission[a + i] for i in range(n) if labels[i]) + sum(transition[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
            for x, y in zip(labels, labels[1:]):
                steps[x, y] += weight
        assert np.allclose(got[a : a + n], good / total)
        pairs += steps / total
    assert np.allclose(expected, pairs)


def test_line_features_of_odd_texts():
    texts = ["", "a", "\n", "a\n\nb", "é " * 5000, "!!\n!!\n!!"]
    bins, weight, first = crf.line_features(texts)
    assert np.diff(first).tolist() == [1, 1, 2, 3, 1, 3] and len(weight) == len(bins) == 11
    alone = [crf.line_features([t])[0].tolist() for t in texts]
    assert [bins[a:b].tolist() for a, b in zip(first, first[1:])] == alone


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = crf.fit_on(documents, labels)
    found = crf.classify(documents, model)
    assert found.count() == documents.count()
    rows = found.join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in unseen]) > 0.98
    again = crf.fit_on(documents.repartition(7), labels.repartition(3))
    assert np.allclose(again.weights, model.weights)  # the fit doesn't depend on partitions


def test_nulls_repeats_no_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "", 2), (None, "x", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = crf.fit_on(frame, none)
    rows = crf.classify(frame, model).collect()
    assert [r["score"] for r in rows] == [0.5] * 4 and not rows[3]["held_out"]
    assert crf.classify(frame.limit(0), model).collect() == []
    assert crf.good_documents(frame, model).columns == frame.columns


def test_fitting_looks_at_some_texts_at_once(monkeypatch):
    texts = ["one two\nthree", None, "a b c d", "", "x" * 90, "!!\n!!", *["a line of words\n"] * 40]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "label": pa.array([1, 0] * 23, pa.int32()), "_text": pa.array(texts)})
    whole = pa.Table.from_batches(crf._line_rows([batch]))
    seen, features = [], crf.line_features
    monkeypatch.setattr(crf, "CHUNK", 64)
    monkeypatch.setattr(crf, "line_features", lambda some: seen.append(some) or features(some))
    assert pa.Table.from_batches(crf._line_rows([batch])).to_pydict() == whole.to_pydict()
    assert whole["id"].to_pylist() == list(range(len(texts)))
    assert all(len(some) == 1 or sum(map(len, some)) <= 64 for some in seen) and len(seen) > 5
