import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from veritab.llm import phrases, quotient, shards


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, max_words=3, least=10, covered=50, top=2000):
    """Rows of the operator by counting everything in dictionaries."""
    out = []
    for lang in {l if l is not None else "und" for _, l in rows}:
        f = Counter()
        for text, l in rows:
            if (l if l is not None else "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
                words = re.findall(r"[^\x20\x09]+", piece)
                for n in range(1, max_words + 1):
                    f.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = [g for g, c in f.items() if len(g) > 1 and c >= least]

        def kept(g):
            longer = [h for h in candidates if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            return all(100 * f[h] < covered * f[g] for h in longer)

        scored = []
        for g in filter(kept, candidates):
            cuts = [(1000000 * f[g] ** 2 // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            scored.append((-score, -f[g], " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = np.random.default_rng(seed)
    words = ["new", "York", "YORK", "city", "of", "é", "in", " x", "a|b", "\x01"]
    glue = [" ", " ", " ", "\t", "\n", ". ", ",", "!"]
    made = []
    for _ in range(n):
        parts = []
        for _ in range(int(r.integers(0, 60))):
            parts += [words[min(len(words) - 1, int(r.exponential(3)))], glue[int(r.integers(0, len(glue)))]]
        made.append(("".join(parts), [None, "en", "de", "und"][int(r.integers(0, 4))]))
    return made


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "least": 3}, {"max_words": 2, "top": 5}, {"least": 2, "covered": 90, "top": None}])
def test_equals_plain_counting(spark, monkeypatch, options):
    monkeypatch.setattr(shards, "SHARD_TOKENS", 300)
    monkeypatch.setattr(shards, "SEGMENT", 64)
    rows = texts(5, 150) + [(None, "en"), ("", None), ("new york new york new york " * 400, "fr")]
    frame = spark.createDataFrame([(t, l, "x", 7) for t, l in rows + rows[:20]], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(frame, **options).collect())
    assert got == plain(rows + rows[:20], **{"top": 2000} | options)


def test_no_documents_and_no_phrases(spark):
    schema = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("one two three", "en"), (None, None)], schema)).collect() == []


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 4_000_000_000_123, 5_000_000_000_001, 6_000_000_000_007
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert frame.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (l * r)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 42), st.integers(1, 3), st.lists(st.integers(0, 2**42 - 1), max_size=60), st.integers(0, 5), st.integers(1, 400))
def test_filters_lose_nothing(bits, words, values, range_bits, times):
    ids = [np.array([(v * (k + 1) + k) % (1 << bits) for v in values], np.int64) for k in range(words)]
    half = quotient.half_width(words, bits)
    keys = quotient.packed_words(ids, bits)
    assert all((a == b).all() for a, b in zip(quotient.unpacked_words(*keys, words, bits), ids))
    mixed = quotient.permuted(*keys, half)
    assert all((a == b).all() for a, b in zip(quotient.restored(*mixed, half), keys))
    whole = quotient.QuotientFilter.of(half, *mixed)
    whole.counts = whole.counts * times
    used = min(range_bits, half)
    found = Counter()
    for number, part in whole.ranges(used):
        back = quotient.QuotientFilter.from_bytes(part.to_bytes(used), number)
        back = quotient.QuotientFilter.merged([back, back])
        grams = quotient.unpacked_words(*quotient.restored(back.high, back.low, half), words, bits)
        found.update(dict(zip(zip(*(g.tolist() for g in grams)), back.counts.tolist())))
    assert found == Counter({g: 2 * times * c for g, c in Counter(zip(*(i.tolist() for i in ids))).items()})


def test_too_wide_keys_are_refused():
    with pytest.raises(ValueError):
        quotient.half_width(4, 40)
