import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import chat, dedup, jaccard, urls
from veritab.llm.bloom import BlockedBloom


def test_dedup_equals_plain_grouping(spark):
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\u00a0b", "A b", "é", "x" * 200000, "a b", "z"] + ["hot"] * 300
    rows = [(1000 - i, t, "q") for i, t in enumerate(texts)] + [(5, "z", "q"), (5, "z", "q"), (None, "z", "q"), (None, "only", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = dedup.deduplicate(frame)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = dedup.without_copies(frame)
    assert kept.columns == frame.columns
    left = [w[0] for w in want if w[3]]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(left)
    assert dedup.deduplicate(frame.limit(0)).collect() == []


def test_a_text_without_any_id_stays_once_in_the_pipeline(spark):
    rows = [(None, "only"), (None, "two  rows"), (None, "two rows"), (None, "z"), (7, "z"), (3, "z"), (4, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = corpus_pipeline.exact_copies(spark, frame, "")
    assert kept.dtypes == frame.dtypes
    want = [(3, "z"), (4, None), (None, "only"), (None, "two  rows")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.exact_copies(spark, frame.limit(0), "").collect() == []


def test_index_remembers_earlier_documents(spark, tmp_path):
    index = dedup.DigestIndex(spark, "digests_of_test", str(tmp_path / "index"), 4)
    one = spark.createDataFrame([(10, "a b"), (11, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "a  b"), (4, "d"), (5, "d")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in dedup.deduplicate(one, index).collect()} == {10: True, 11: True}
    found = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in dedup.deduplicate(two, index).collect()}
    assert found == {3: (10, False, 1), 4: (4, True, 2), 5: (4, False, 2)}
    assert index.rows().count() == 3
    plan = index.rows().join(index.rows().alias("x"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # bucketed by digest
    spark.sql("DROP TABLE digests_of_test")


def test_an_index_is_opened_with_its_own_layout_only(spark, tmp_path):
    folder, schema = str(tmp_path / "index"), "doc_id long, text string"
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(500)], schema)
    again = spark.createDataFrame([(i + 1000, f"text {i}") for i in range(500)], schema)
    dedup.deduplicate(texts, dedup.DigestIndex(spark, "layout_of_test", folder, 4)).collect()
    spark.sql("DROP TABLE layout_of_test")  # as in a new session with a catalog in memory
    for wrong in (8, 3):
        with pytest.raises(ValueError):
            dedup.DigestIndex(spark, "layout_of_test", folder, wrong)
    index = dedup.DigestIndex(spark, "layout_of_test", folder)
    assert index.buckets == 4 and index.rows().count() == 500
    found = dedup.deduplicate(again, index).collect()
    assert all(r["keep_id"] == r["doc_id"] - 1000 and not r["kept"] for r in found)
    assert index.rows().count() == 500
    with pytest.raises(ValueError):
        dedup.DigestIndex(spark, "layout_of_test", str(tmp_path / "other"))
    spark.sql("DROP TABLE layout_of_test")


def test_batches_change_nothing(spark):
    rows = [(i, f"t{i % 37}") for i in range(-20, 300)] + [(None, "t3"), (None, "new"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, dedup.deduplicate(frame).collect()), key=repr)
    for batches in (2, 5):
        assert sorted(map(tuple, dedup.deduplicate(frame, batches=batches).collect()), key=repr) == want
    assert dedup.deduplicate(frame.limit(0), batches=3).collect() == []


def test_rows_delivered_twice_stay_once_in_the_pipeline(spark):
    rows = [(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 1}), (2, "x", {}), (2, "x", {"z": 2}), (2, "y", None), (None, "x", {}), (3, None, {}), (3, "", {})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = [(r["doc_id"], r["text"]) for r in dedup.without_copies(frame, keep_unnamed=True).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "a b c d e f"), (2, "x"), (2, "y"), (3, "")], key=repr) or sorted(kept, key=repr) == sorted([(1, "a b c d e f"), (2, "x"), (2, "y"), (3, None)], key=repr)
    left = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(frame).collect()]
    assert left.count((1, "a b c d e f")) == 1 and left.count((2, "x")) == 1


def test_bloom_never_misses(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bloom = BlockedBloom.of(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    assert bloom.may_hold(hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000).view(np.uint64)
    assert bloom.may_hold(others).mean() < 0.1
    empty = BlockedBloom.of(spark.createDataFrame([], "hash long"))
    assert not empty.may_hold(others).any()


RULES = [("org", "/", "allow", True), ("example.org", "/es/", "block", True), ("example.org", "/en/1", "block", True),
         ("com", "/fr/", "allow", True), ("com", "/de/", "block", True), ("bad.net", "", "block", False), (None, "/x", "block", True)]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(rule, len(h + p), h + p, v) for h, p, v, rule in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    rule, _, text, verdict = max(fits)
    return host, path, text if rule else None, verdict


def test_urls_equal_plain_rules(spark):
    odd = [None, "", "nothing", "://", "http://", "http://ORG/", "http://org", "http://org/", "http://xorg/", "http://a.EXAMPLE.org/es/x?y#z", "http://example.org/en/12",
           "http://example.org/en/2", "https://a.com/fr/1", "https://com/de/", "https://a.com/de", "http://a.com?x=/fr/", "http://a.com#/fr/", "x://bad.net/q", "x://very.bad.net",
           "x://notbad.net/", "a://b://c.com/fr/", "http:// com/fr/", "http://É.com/fr/", "http://" + "a." * 3000 + "org/"]
    r = random.Random(3)
    odd += ["".join(r.choices(["http://", "com", "org", ".", "example", "/", "fr/", "de/", "es/", "en/1", "?", "#", "a", "bad.net"], k=8)) for _ in range(1500)]
    rows = [(i // 2, u, 1) for i, u in enumerate(odd)] + [(None, "http://a.org/", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = urls.judge(frame, urls.listed_frame(spark, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, *plain_verdict(u)) for i, u, _ in rows], key=repr)
    assert urls.judge(frame.limit(0), urls.listed_frame(spark, RULES)).collect() == []
    assert {r["verdict"] for r in urls.judge(frame, urls.listed_frame(spark, [])).collect()} == {"allow"}


CONTROL = ["### ", "###", "#", "\\", "</turn>", "<", "/turn>", "<image:1>", "<image:", "\n", ":", "assistant", "ok", "é", "😀", " ", "### user:\n", "\n</turn>\n"]


def test_escapes_are_reversible():
    r = random.Random(9)
    for _ in range(20000):
        text = "".join(r.choices(CONTROL, k=r.randint(0, 12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and "##" not in shown and "</turn>" not in shown and "<image:" not in shown
        assert chat.unescape(chat.escape_role(text)) == text and ":\n" not in chat.escape_role(text)


def test_conversations_read_back(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "Assistant", None, "a:\nb"]), "".join(r.choices(CONTROL, k=r.randint(0, 9))) if r.random() < 0.9 else None, 0)
            for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "x", 0), (None, None, "assistant", "y", 0), (99, 1, "assistant", "b", 0), (99, 1, "assistant", "a", 0), (99, 1, "assistant", "a", 0)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    parts = frame.withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_conversations(parts)
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1], x[2] is not None, x[2], x[3] is not None, x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {x["conv_id"]: x for x in formatted.collect()}
    assert got.keys() == want.keys()
    digests = {x["conv_id"]: x for x in chat.formatting_digests(formatted).collect()}
    for c, turns in want.items():
        assert chat.read_back(got[c]["formatted"]) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        d = digests[c]
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (d["n_turns"], d["loss_chars"], d["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d["formatted_chars"] == len(got[c]["formatted"])


def test_attachments_keep_their_order(spark):
    rows = [(1, 0, "user", [("text", "see <image:1> ", None, None), ("image", None, "s/a.png", 4), ("audio", None, "s/b.wav", None), ("text", "and", None, None)]),
            (1, 1, "assistant", [("document", None, "c.pdf", 2), ("text", None, None, None)]), (2, 0, "user", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {x["conv_id"]: x for x in chat.format_conversations(frame).collect()}
    assert got[1]["formatted"] == "### user:\nsee <\\image:1> <image:1><audio:2>and\n</turn>\n### assistant:\n<document:3>\n</turn>\n"
    assert [(a["type"], a["ref"], a["turn"], a["tokens"]) for a in got[1]["attachments"]] == [
        ("image", "s/a.png", 0, 1024), ("audio", "s/b.wav", 0, 25), ("document", "c.pdf", 1, 1024)]
    for a in got[1]["attachments"]:
        assert got[1]["formatted"][a["at"] :].startswith(f"<{a['type']}:")
    assert got[2]["formatted"] == "### user:\n\n</turn>\n" and got[2]["attachments"] == []
    assert chat.format_conversations(frame.limit(0)).collect() == []
