import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from veritab.llm import pitman, shards


def tokens_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def corpus(seed, n):
    """Texts of a small Markov chain with many words."""
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    after = {w: r.choice(words, 4) for w in words}
    out = []
    for i in range(n):
        w, text = r.choice(words), []
        for _ in range(int(r.integers(1, 40))):
            text.append(w.upper() if r.random() < 0.1 else w)
            w = r.choice(after.get(w, words)) if r.random() < 0.8 else (r.choice(words) if r.random() < 0.9 else f"rare{r.integers(10**6)}")
        out.append((i, " \n\t"[int(r.integers(3))].join(text)))
    return out


ODD = [(900, None), (901, ""), (902, " \t\n"), (None, "w1 w2"), (903, "w1 w2 w3"), (903, "w1 w2 w3"), (904, "never seen before")]


def scored(spark, rows, trained=None, **options):
    frame = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, counted boolean").repartition(3)
    trained = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)) if trained is None else trained
    return pitman.score_texts(frame, trained, **options)


def learned(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def chinese_restaurant_scores(rows, discounts, strength, sweeps, burn_in, seed):
    """The same model, customer by customer, in plain Python."""
    r = np.random.default_rng(seed)
    data = [tokens_of(t) for i, t in rows if learned(i)]
    kinds = len({w for d in data for w in d})
    unit = 1 / (kinds + 1)
    seats = defaultdict(list)  # (context, word): customers of each table
    root = defaultdict(list)
    total, tables = Counter(), Counter()

    def weight(sizes, discount):
        return sum(sizes) - discount * len(sizes)

    def p_root(w):
        c, t = total[None], tables[None]
        return unit if not c else (weight(root[w], discounts[0]) + (strength + discounts[0] * t) * unit) / (strength + c)

    def p(u, w):
        c, t = total[u], tables[u]
        return p_root(w) if not c else (weight(seats[u, w], discounts[1]) + (strength + discounts[1] * t) * p_root(w)) / (strength + c)

    def sit(sizes, new, discount):
        chances = np.array([n - discount for n in sizes] + [new])
        k = r.choice(len(chances), p=chances / chances.sum())
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def leave(sizes):
        k = r.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def add(u, w):
        opened = sit(seats[u, w], (strength + discounts[1] * tables[u]) * p_root(w), discounts[1])
        total[u] += 1
        if opened:
            tables[u] += 1
            if sit(root[w], (strength + discounts[0] * tables[None]) * unit, discounts[0]):
                tables[None] += 1
            total[None] += 1

    def remove(u, w):
        total[u] -= 1
        if leave(seats[u, w]):
            tables[u] -= 1
            total[None] -= 1
            if leave(root[w]):
                tables[None] -= 1

    pairs = [(u, w) for d in data for u, w in zip([None.__class__, *d], d)]
    for u, w in pairs:
        add(u, w)
    sums, kept = Counter(), 0
    asked = {(u, w) for _, t in rows for u, w in zip([None.__class__, *tokens_of(t)], tokens_of(t))}
    for sweep in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if sweep >= burn_in:
            kept += 1
            for u, w in asked:
                sums[u, w] += p(u, w)
    return [sum(math.log10(sums[u, w] / kept) for u, w in zip([None.__class__, *tokens_of(t)], tokens_of(t))) for _, t in rows]


def test_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_TOKENS", 400)
    rows = corpus(1, 120) + ODD
    got = sorted(([r[c] for c in ("id", "counted", "n_tokens", "n_known", "train_tokens", "base_score")] for r in scored(spark, rows).collect()), key=repr)
    c = Counter(w for i, t in rows if learned(i) for w in tokens_of(t))
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = tokens_of(t)
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        want.append([i, learned(i), len(own), sum(c[w] > 0 for w in own), total, base])
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_close_to_a_restaurant_run_customer_by_customer(spark):
    rows = corpus(2, 150) + ODD
    frame = scored(spark, rows, samples=12, burn_in=4)
    got = {(r["id"], r["n_tokens"]): r["score"] for r in frame.collect()}
    # The discounts that the operator estimates, from the same counts.
    pairs = Counter((u, w) for i, t in rows if learned(i) for u, w in zip([0, *tokens_of(t)], tokens_of(t)))
    lower = pitman._discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    words = Counter(w for _, w in pairs)
    upper = pitman._discount(sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
    want = chinese_restaurant_scores(rows, (upper, lower), 1.0, 30, 10, 3)
    found = np.array([got[i, len(tokens_of(t))] for i, t in rows])
    assert abs(found.sum() / np.sum(want) - 1) < 0.01
    assert np.abs(found - want).max() < 0.05 * np.abs(want).max()


def test_beats_the_base_on_texts_it_has_not_seen(spark):
    rows = [r for r in scored(spark, corpus(3, 400)).collect() if not r["counted"]]
    assert len(rows) > 40
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("tile_tokens", [20, 4_000_000])
def test_probabilities_add_up_to_one(spark, monkeypatch, tile_tokens):
    monkeypatch.setattr(pitman, "TILE_TOKENS", tile_tokens)
    held = {}
    monkeypatch.setattr(pitman, "scored", lambda streams, model: held.update(model=model) or streams)
    scored(spark, corpus(4, 80))
    model, layout = held["model"], held["model"].layout
    words = np.append(followers(model), layout.words)
    assert len(words) == model.kinds + 1
    contexts = np.append(words, layout.words + 1)
    keys = np.sort(layout.keys(np.repeat(contexts, len(words)), np.tile(words, len(contexts))))
    rows = pitman.model_rows(model).toArrow()
    run = pitman._answers(layout, model.discounts, model.strength, model.unit, [r for _, r in model.sides])
    total = defaultdict(float)
    for tile, a, b in layout.pieces(keys):
        asked = pa.table({"tile": [tile], "shard": ["s"], "keys": pa.array([pitman.packed_sorted(keys[a:b])])})
        log_p = np.frombuffer(run(rows.filter(pc.equal(rows["tile"], tile)).drop(["tile"]), asked)["scores"][0].as_py(), np.float32)
        context = (keys[a:b] >> (2 * layout.bits)) // layout.blocks * layout.size + layout.split(keys[a:b])[1]
        for u, x in zip(context.tolist(), log_p.tolist()):
            total[u] += 10**x
    assert len(total) == len(contexts) and np.allclose(list(total.values()), 1, atol=1e-5)


def followers(model):
    """The ids of all known words: every one follows something."""
    out = []
    for frame in (model.pairs, model.singles):
        for r in frame.select("block", "keys").collect():
            keys, layout = pitman.unpacked_sorted(r["keys"]), model.layout
            word = r["block"] % layout.blocks * layout.size + layout.split(keys)[2]
            out.append(word)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("c,others,base,discount,strength", [(6, 3, 0.2, 0.5, 1.0), (5, 0, 0.01, 0.8, 0.3), (6, 40, 0.9, 0.2, 2.0)])
def test_tables_follow_the_seating_posterior(c, others, base, discount, strength):
    """Against all ways to seat c customers of a dish."""
    weight = np.zeros(c + 1)
    for seats in itertools.product(range(c), repeat=c):
        if any(s > max(seats[:i], default=-1) + 1 for i, s in enumerate(seats)):
            continue  # tables are numbered by their first customer
        sizes, p = [], 1.0
        for s in seats:
            if s == len(sizes):
                p *= (strength + discount * (others + len(sizes))) * base
                sizes.append(1)
            else:
                p *= sizes[s] - discount
                sizes[s] += 1
        weight[len(sizes)] += p
    n = 40_000
    drawn = pitman.drawn_tables(np.full(n, c), np.full(n, others), np.full(n, base), discount, strength, np.random.default_rng(1))
    share = np.bincount(drawn, minlength=c + 1) / n
    assert np.abs(share - weight / weight.sum()).max() < 0.01


def test_many_customers_of_a_dish_stay_within_reason():
    drawn = pitman.drawn_tables(np.array([5000, 300, 1]), np.array([100, 100, 0]), np.array([0.01, 0.01, 0.5]), 0.7, 1.0, np.random.default_rng(1))
    assert drawn[2] == 1 and 2 <= drawn[1] < drawn[0] < 1000


def test_nothing_to_learn_from_and_no_documents(spark):
    rows = scored(spark, [(1, "a b"), (2, None)], F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert scored(spark, []).collect() == []
