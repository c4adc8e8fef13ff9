import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm import brute  # noqa: E402
from veritab.llm import crf, pii  # noqa: E402
from veritab.session import materialize  # noqa: E402

SHOWN = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def masked(text):
    out, at = "", 0
    for kind, a, b in brute.base_spans(text):
        if a >= at:
            out += text[at:a] + SHOWN[kind]
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder))
        out.append((name, docs))
    return spark.read.parquet(f"{folder}/documents.parquet"), out


def test_every_stage_equals_a_plain_version(spark, stages):
    folder, (documents, found) = "/root/testdata/sf0.001", stages
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = crf.fit_on(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    ids = sorted(rows)
    rows = {i: rows[i] for i, s in zip(ids, model.score([rows[i] or "" for i in ids])) if s >= 0.7}
    kept = [dict((r["doc_id"], r["text"]) for r in frame.collect()) for _, frame in found[:4]]
    assert kept[0] == rows
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    rows = {i: rows[i] for i in first.values()}
    assert kept[1] == rows
    rows = {i: rows[i] for i, _, c in brute.jaccard_components(list(rows.items())) if i == c}
    assert kept[2] == rows
    frame = found[2][1]
    assert pii.disclosing_terms(frame).count() == 0  # so that only base kinds are replaced here
    rows = {i: masked(t) for i, t in rows.items()}
    assert kept[3] == rows
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    placed = found[4][1].collect()
    got = {}
    for r in placed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    used = {}
    for r in placed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_stages_return_the_columns_of_documents(stages):
    documents, found = stages
    for _, frame in found[:-1]:
        assert frame.dtypes == documents.dtypes
    lengths = {r["doc_id"]: (r["n_chars"], len(r["text"])) for r in found[3][1].collect()}
    assert all(a == b for a, b in lengths.values())


def test_stages_on_no_rows_and_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "call +1 555 123 4567 now", "en", "s", 24)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = materialize(stage(spark, docs, folder))
            assert data or docs.count() == 0
    good = corpus_pipeline.quality(spark, spark.createDataFrame(rows, schema), folder)
    assert good.schema == schema and good.count() <= 4
