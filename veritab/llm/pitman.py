"""Language model scores by a hierarchical Pitman-Yor process.

Method: every context word has a restaurant whose customers are the words that follow it; all context
restaurants share one parent, the root, whose customers are their tables and whose own parent is uniform
over the known words and one unknown (Teh, "A Hierarchical Bayesian Language Model based on Pitman-Yor
Processes", 2006). Seatings are drawn by Gibbs sampling: the tables of a dish in a restaurant are drawn
anew given all other tables there and the parent's probability, then the root is drawn given the tables
below it. After some rounds the predictive probabilities of several seatings are averaged.

On Spark: pairs (context, word) lie in square tiles of word ids, so that neither a frequent context nor
a frequent word lies in one task. A tile gets the totals of its contexts and the root's state of its
words as arrays, draws its seatings, and returns sums over its rows and columns. All dishes of a
restaurant move at once and see the totals of the round before. Shards of texts (see ``shards``) ask
each tile once for every pair they hold and add up the answers by document; so a pair that stands in all
documents is asked for once per shard. Draws are seeded by tile and round: a task that runs again
draws the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.llm.shards import global_stream, over_shards, packed, packed_sorted, shard_texts, unpacked, unpacked_sorted, with_ids, word_counts
from veritab.session import discard, materialize

#: Fixed value: what a word is, by the contract.
WORD = rb"[^\x20\x09-\x0D]+"
#: The token after each text. No word is empty.
END = b""
#: Up to so many customers of a dish are seated by their exact conditional distribution.
EXACT = 256
#: Tokens that a tile is laid out for.
TILE_TOKENS = 4_000_000
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0


@cache
def log_partitions(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t): generalised Stirling numbers, the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        stay = np.full(most + 1, -np.inf)
        room = c - t * discount
        np.log(room, out=stay, where=room > 0)
        out[c + 1] = out[c] + stay
        out[c + 1, 1:] = np.logaddexp(out[c + 1, 1:], out[c, :-1])
    return out


def drawn_tables(
    customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, random: np.random.Generator
) -> np.ndarray:
    """Tables of each dish given its customers, the other tables of its restaurant and the parent's probability.

    Up to EXACT customers the draw is exact: p(t) is S(c, t) base**t times the weight of t more tables.
    The customers after these are seated in order, blocks of a sixteenth of those seated at a time.
    """
    tables = np.ones(len(customers), np.int64)
    weights = log_partitions(discount)
    capped = np.minimum(customers, EXACT)
    order = np.argsort(capped, kind="stable")
    bounds = np.searchsorted(capped[order], np.arange(2, EXACT + 2))
    start = [strength + discount * others, np.log(base)]
    for c in range(2, EXACT + 1):
        which = order[bounds[c - 2] : bounds[c - 1]]
        step = max(1, (1 << 21) // c)
        for i in range(0, len(which), step):
            rows = which[i : i + step]
            opened = np.log(start[0][rows, None] + discount * np.arange(c)) + start[1][rows, None]
            log_p = np.cumsum(opened, axis=1) + weights[c, 1 : c + 1]
            p = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            point = random.random(len(rows)) * p[:, -1]
            tables[rows] = 1 + np.minimum((p <= point[:, None]).sum(axis=1), c - 1)
    rest = np.flatnonzero(customers > EXACT)
    seated = np.full(len(rest), EXACT)
    while len(rest):
        block = np.minimum(customers[rest] - seated, seated // 16)
        new = (start[0][rest] + discount * tables[rest]) * base[rest]
        tables[rest] += random.binomial(block, new / (seated - discount * tables[rest] + new))
        seated = seated + block
        left = seated < customers[rest]
        rest, seated = rest[left], seated[left]
    return tables


@dataclass(frozen=True)
class Layout:
    """Ids 0 .. words-1, one for unknown words, one for the begin of a text; ``bits`` low bits within a block."""

    words: int
    bits: int
    blocks: int

    @classmethod
    def of(cls, top_id: int, tokens: int, partitions: int) -> Layout:
        words = top_id + 1
        sides = max(math.isqrt(max(0, partitions - 1)) + 1, math.isqrt(tokens // TILE_TOKENS) + 1)
        bits = max(0, (max(1, -(-(words + 2) // sides)) - 1).bit_length())
        return cls(words, bits, ((words + 1) >> bits) + 1)

    @property
    def size(self) -> int:
        return 1 << self.bits

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Tile, then the places within it."""
        tile = (context >> self.bits) * self.blocks + (word >> self.bits)
        low = self.size - 1
        return (((tile << self.bits) | (context & low)) << self.bits) | (word & low)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.size - 1
        return keys >> (2 * self.bits), (keys >> self.bits) & low, keys & low

    def pieces(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(tile, from, to) of sorted keys."""
        tile = keys >> (2 * self.bits)
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return [(int(tile[a]), int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(keys)))]


def _token_keys(layout: Layout, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Key of every token of a shard, and where its texts start."""
    stream, lengths = unpacked(row["stream"]), np.array(row["lengths"], np.int64)
    starts = np.cumsum(lengths) - lengths
    context = np.empty_like(stream)
    context[1:] = stream[:-1]
    context[starts] = layout.words + 1
    return layout.keys(context, stream), starts


STREAM_SCHEMA = "shard string, stream binary, ids array<long>, lengths array<int>, counted array<boolean>, known array<long>, base array<double>"


def _numbered(layout: Layout, tokens: int, kinds: int):
    """Shards as ids of the corpus, with the base figures of each text."""

    def run(row: dict, words: dict) -> pa.Table:
        columns = STREAM_SCHEMA.split(", ")
        names = [c.split(" ")[0] for c in columns]
        kinds_of = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        schema = pa.schema(list(zip(names, kinds_of)))
        if not row:
            return schema.empty_table()
        stream = global_stream(row, words, layout.words)
        local = unpacked(row["stream"])
        counts = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        counts[words["pos"]] = words["count"]
        c = counts[local]
        lengths = np.array(row["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1))), starts)
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        values = [row["shard"], packed(stream), row["ids"], row["lengths"], row["counted"], known, base]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds_of)], schema=schema)

    return run


def _wanted(layout: Layout, trained: bool):
    """Per shard and tile the sorted different keys; of trained texts only with their counts, or of all."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                keys, _ = _token_keys(layout, row)
                if trained:
                    keys = keys[np.repeat(np.array(row["counted"], bool), row["lengths"])]
                keys = np.sort(keys)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                times, keys = np.diff(np.append(first, len(keys))), keys[first]
                for tile, a, b in layout.pieces(keys):
                    counts = packed(times[a:b]) if trained else None
                    columns = [pa.array([tile]), pa.array([row["shard"]]), pa.array([packed_sorted(keys[a:b])]), pa.array([counts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["tile", "shard", "keys", "counts"])

    return run


MODEL_SCHEMA = "kind string, block long, keys binary, counts binary, tables binary, total binary, customers long"
MODEL = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tables", pa.binary()), ("total", pa.binary()), ("customers", pa.int64())])


def _model_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(MODEL)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, MODEL)], schema=MODEL)


def _sums(layout: Layout, keys: np.ndarray, tables: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """What a tile's pairs add to its contexts (tables, customers) and its words (customers of the root)."""
    tiles, rows, columns = layout.split(keys)
    tile = int(tiles[0])
    add = lambda place, of: packed(np.bincount(place, of, layout.size).astype(np.int64))
    return [
        ("context", tile // layout.blocks, None, add(rows, counts), add(rows, tables), None, int(tables.sum())),
        ("word", tile % layout.blocks, None, add(columns, tables), None, None, int(tables.sum())),
    ]


def _pairs(layout: Layout):
    """All shards' pairs of a tile: those seen once, which never move, apart from the others."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked_sorted(x.as_py()) for x in table["keys"]])
        counts = np.concatenate([unpacked(x.as_py()) for x in table["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        tile, often = table["tile"][0].as_py(), counts > 1
        ones = np.ones(len(keys), np.int64)
        rows = [
            ("single", tile, packed_sorted(keys[~often]), None, None, None, int((~often).sum())),
            ("pair", tile, packed_sorted(keys[often]), packed(counts[often]), packed(ones[often]), packed(0 * ones[often]), int((counts == 2).sum())),
        ]
        return _model_rows(rows + _sums(layout, keys, ones, counts))

    return run


def _added(random_of, discount: float, strength: float, root_tables: int, unit: float):
    """Sum the tiles' arrays of a block; the root's dishes also get new tables."""

    def run(table: pa.Table) -> pa.Table:
        kind, block = table["kind"][0].as_py(), table["block"][0].as_py()
        new = table["keys"].is_null().to_pylist()  # an old root row carries its tables under ``keys``
        total = lambda c: sum(unpacked(x.as_py()) for x, n in zip(table[c], new) if n)
        counts = total("counts")
        if kind == "context":
            tables = total("tables")
        else:
            old = [unpacked(x.as_py()) for x, n in zip(table["keys"], new) if not n]
            before = np.minimum(old[0], counts) if old else (counts > 0).astype(np.int64)
            tables = np.zeros(len(counts), np.int64)
            dishes = np.flatnonzero(counts > 0)
            others = np.maximum(0, root_tables - before[dishes])
            base = np.full(len(dishes), unit)
            tables[dishes] = drawn_tables(counts[dishes], others, base, discount, strength, random_of(block)) if root_tables else before[dishes]
        return _model_rows([(kind, block, None, packed(counts), packed(tables), None, int(tables.sum()))])

    return run


def root_probability(customers, tables, all_customers: int, all_tables: int, discount: float, strength: float, unit: float):
    if not all_customers:
        return np.full(len(customers), unit)
    open_share = (strength + discount * all_tables) / (strength + all_customers)
    return np.maximum(0.0, customers - discount * tables) / (strength + all_customers) + open_share * unit


@dataclass(frozen=True)
class Root:
    """The root's totals in one round."""

    customers: int
    tables: int


@dataclass
class Model:
    """``pairs`` and ``singles`` by tile, the context and word arrays of each kept seating, and the scalars."""

    layout: Layout
    tokens: int
    kinds: int
    discounts: tuple[float, float]
    strength: float
    pairs: DataFrame
    singles: DataFrame
    sides: list[tuple[DataFrame, Root]]

    @property
    def unit(self) -> float:
        return 1.0 / (self.kinds + 1)


def _on_tiles(layout: Layout, sides: DataFrame, sample: int) -> DataFrame:
    """The arrays of a block for each tile of its row or column."""
    other = F.explode(F.sequence(F.lit(0), F.lit(layout.blocks - 1)))
    spread = sides.select(F.lit(sample).alias("sample"), "*", other.alias("_other"))
    tile = F.when(F.col("kind") == "context", F.col("block") * layout.blocks + F.col("_other")).otherwise(F.col("_other") * layout.blocks + F.col("block"))
    return spread.withColumn("tile", tile.cast("long")).select("tile", "sample", "kind", "keys", "counts", "tables", "total")


def _by_kind(table: pa.Table) -> dict[tuple[str, int], dict]:
    return {(r["kind"], r["sample"]): r for r in table.to_pylist()}


def _round(layout: Layout, discounts: tuple[float, float], strength: float, unit: float, root: Root, number: int, kept: bool, seed: int):
    """Draw new tables for the pairs of a tile."""

    def run(model: pa.Table, sides: pa.Table) -> pa.Table:
        if not len(model):
            return MODEL.empty_table()
        row, side = model.to_pylist()[0], _by_kind(sides)
        keys, counts, before = unpacked_sorted(row["keys"]), unpacked(row["counts"]), unpacked(row["tables"])
        if not len(keys):
            return _model_rows([("pair", row["block"], row["keys"], row["counts"], row["tables"], row["total"], 0)])
        _, rows, columns = layout.split(keys)
        word, context = side["word", 0], side["context", 0]
        base = root_probability(unpacked(word["counts"]), unpacked(word["tables"]), root.customers, root.tables, discounts[0], strength, unit)
        others = np.maximum(0, unpacked(context["tables"])[rows] - before)
        random = np.random.default_rng((seed, number, row["block"]))
        tables = drawn_tables(counts, others, base[columns], discounts[1], strength, random)
        total = unpacked(row["total"]) + (tables if kept else 0)
        state = ("pair", row["block"], row["keys"], row["counts"], packed(tables), packed(total), 0)
        return _model_rows([state] + _sums(layout, keys, tables, counts))

    return run


def _discount(once: int, twice: int) -> float:
    """The usual estimate from how many are seen once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def fit(streams: DataFrame, layout: Layout, tokens: int, kinds: int, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = 42) -> Model:
    """Seat the counted texts of ``streams``: ``burn_in`` rounds, then ``samples`` rounds that are kept."""
    unit = 1.0 / (kinds + 1)
    asked = streams.select("shard", "stream", "lengths", "counted").mapInArrow(_wanted(layout, True), "tile long, shard string, keys binary, counts binary")
    rows = materialize(asked.groupBy("tile").applyInArrow(_pairs(layout), MODEL_SCHEMA))
    singles, pairs = rows.filter("kind = 'single'"), rows.filter("kind = 'pair'")
    seen = {r["kind"]: r["n"] or 0 for r in rows.groupBy("kind").agg(F.sum("customers").alias("n")).collect()}
    lower = _discount(seen.get("single", 0), seen.get("pair", 0))
    # Pairs seen once have one table each; what they add to their contexts and words never changes.
    ones = singles.select(F.col("block").alias("tile"), "keys").mapInArrow(_single_sums(layout), MODEL_SCHEMA)
    fixed = materialize(ones.groupBy("kind", "block").applyInArrow(_added_plain, MODEL_SCHEMA))
    upper, sides, root, kept = 0.5, None, Root(0, 0), []
    parts, state = rows.filter("kind IN ('context', 'word')"), None
    for number in range(burn_in + samples + 1):
        if number:
            held = number > burn_in
            step = _round(layout, (upper, lower), strength, unit, root, number, held, seed)
            tiles = pairs.withColumn("tile", F.col("block")).groupBy("tile")
            found = materialize(tiles.cogroup(_on_tiles(layout, sides, 0).groupBy("tile")).applyInArrow(step, MODEL_SCHEMA))
            pairs = found.filter("kind = 'pair'")
            if state is not None:
                discard(state)  # the round before
            state = found
            old = sides.filter("kind = 'word'").select("kind", "block", F.col("tables").alias("keys"), "counts", "tables", "total", "customers")
            parts = found.filter("kind IN ('context', 'word')").unionByName(fixed).unionByName(old)
        random_of = _Seeds(seed, number)
        sides = materialize(parts.groupBy("kind", "block").applyInArrow(_added(random_of, upper, strength, root.tables, unit), MODEL_SCHEMA))
        sums = sides.groupBy("kind").agg(F.sum("customers").alias("n")).collect()
        sums = {r["kind"]: r["n"] for r in sums}
        # The root's customers are the tables of all contexts.
        root = Root(sums.get("context", 0), sums.get("word", 0))
        if not number:
            upper = _root_discount(sides)
        if number > burn_in:
            kept.append((sides, root))
    return Model(layout, tokens, kinds, (upper, lower), strength, pairs, singles, kept)


class _Seeds:
    def __init__(self, *numbers: int):
        self.numbers = numbers

    def __call__(self, block: int) -> np.random.Generator:
        return np.random.default_rng((*self.numbers, block, 1))


def _single_sums(layout: Layout):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                keys = unpacked_sorted(batch.column("keys")[i].as_py())
                if len(keys):
                    ones = np.ones(len(keys), np.int64)
                    yield from _model_rows(_sums(layout, keys, ones, ones)).to_batches()

    return run


def _added_plain(table: pa.Table) -> pa.Table:
    """Sums of arrays alone."""
    total = lambda c: packed(sum(unpacked(x.as_py()) for x in table[c])) if table[c][0].as_py() is not None else None
    kind, block = table["kind"][0].as_py(), table["block"][0].as_py()
    return _model_rows([(kind, block, None, total("counts"), total("tables"), None, int(sum(table["customers"].to_pylist())))])


def _root_discount(sides: DataFrame) -> float:
    """From the words that follow one and two different contexts."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts = unpacked(data)
                yield pa.RecordBatch.from_arrays([pa.array([int((counts == k).sum())]) for k in (1, 2)], ["one", "two"])

    words = sides.filter("kind = 'word'").select("counts").mapInArrow(run, "one long, two long")
    one, two = words.agg(F.sum("one"), F.sum("two")).first()
    return _discount(one or 0, two or 0)


def _answers(model_layout: Layout, discounts: tuple[float, float], strength: float, unit: float, roots: list[Root]):
    """log10 of the averaged probability of every pair that a shard asks a tile for."""
    layout = model_layout

    def run(model: pa.Table, asked: pa.Table) -> pa.Table:
        shards, data = [], []
        found = _by_kind(model)
        none = np.zeros(layout.size, np.int64)
        pair, single = found.get(("pair", -1)), found.get(("single", -1))
        keys = unpacked_sorted(pair["keys"]) if pair else none[:0]
        counts, total = (unpacked(pair[c]) if pair else none[:0] for c in ("counts", "total"))
        ones = unpacked_sorted(single["keys"]) if single else none[:0]
        context = [found.get(("context", s)) for s in range(len(roots))]
        customers = unpacked(context[0]["counts"]) if context and context[0] else none
        open_share, root = [], []
        for s, r in enumerate(roots):
            tables = unpacked(context[s]["tables"]) if context[s] else none
            open_share.append((strength + discounts[1] * tables) / (strength + customers))
            word = found.get(("word", s))
            root.append(root_probability(*((unpacked(word["counts"]), unpacked(word["tables"])) if word else (none, none)), r.customers, r.tables, discounts[0], strength, unit))
        for shard, wanted in zip(asked["shard"].to_pylist(), asked["keys"].to_pylist()):
            want = unpacked_sorted(wanted)
            _, rows, columns = layout.split(want)
            c, t = np.zeros(len(want)), np.zeros(len(want))
            for held, many, mean in ((keys, counts, total / max(1, len(roots))), (ones, 1, 1)):
                at = np.minimum(np.searchsorted(held, want), max(0, len(held) - 1))
                hit = held[at] == want if len(held) else np.zeros(len(want), bool)
                c[hit] = many[at[hit]] if len(np.shape(many)) else many
                t[hit] = mean[at[hit]] if len(np.shape(mean)) else mean
            visited = customers[rows] > 0
            p = np.zeros(len(want))
            for share, base in zip(open_share, root):
                p += np.where(visited, share[rows], 1.0) * base[columns] / len(roots)
            p += np.where(visited, np.maximum(0.0, c - discounts[1] * t) / (strength + customers[rows]), 0.0)
            shards.append(shard)
            data.append(np.log10(p).astype(np.float32).tobytes())
        tile = asked["tile"].to_pylist()
        return pa.table({"shard": pa.array(shards, pa.string()), "tile": pa.array(tile, pa.int64()), "scores": pa.array(data, pa.binary())})

    return run


def _documents(layout: Layout):
    """Add up the answers of all tiles by text."""
    kinds = pa.schema([("id", pa.int64()), ("counted", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return kinds.empty_table()
        row = {c: left[c][0].as_py() for c in left.column_names}
        keys, starts = _token_keys(layout, row)
        order = np.argsort(right["tile"].to_numpy(), kind="stable")
        answers = [right["scores"][int(i)].as_py() for i in order]
        scores = np.frombuffer(b"".join(answers), np.float32).astype(np.float64)
        _, place = np.unique(keys, return_inverse=True)
        total = np.add.reduceat(scores[place], starts)
        columns = [row["ids"], row["counted"], row["lengths"], row["known"], row["base"], total]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


def score_texts(
    documents: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text",
    burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = 42,
) -> DataFrame:
    """(id, counted, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents``.

    The model learns from the rows where ``trained`` holds (null: it does not); without any it is uniform.
    ``score`` is the log10 probability of the text's tokens and its end, ``base_score`` that of the smoothed
    counts of single tokens. Single answers are kept with seven digits. A null text is empty and has one token,
    its end. Repeated rows are scored, and learned from, each for itself. No documents, no rows.
    """
    spark: SparkSession = documents.sparkSession
    shards = materialize(shard_texts(documents, F.col(text_col), WORD, key=F.col(id_col), counted=trained, end=END))
    words = materialize(with_ids(word_counts(shards).filter("count > 0")))
    top, tokens, kinds = words.agg(F.max("id"), F.sum("count"), F.count("*")).first()
    tokens, partitions = int(tokens or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = Layout.of(-1 if top is None else int(top), tokens, partitions)
    streams = materialize(over_shards(shards, words, _numbered(layout, tokens, kinds), STREAM_SCHEMA))
    discard(shards)
    discard(words)
    model = fit(streams, layout, tokens, kinds, burn_in, samples, strength, seed)
    return scored(streams, model).withColumn("train_tokens", F.lit(tokens).cast("long"))


def model_rows(model: Model) -> DataFrame:
    """Everything that a tile needs to answer: its pairs, and each kept seating's arrays of its contexts and words."""
    rows = [h.select(F.col("block").alias("tile"), F.lit(-1).alias("sample"), "kind", "keys", "counts", "tables", "total") for h in (model.pairs, model.singles)]
    rows += [_on_tiles(model.layout, sides, s) for s, (sides, _) in enumerate(model.sides)]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole


def scored(streams: DataFrame, model: Model) -> DataFrame:
    """(id, counted, n_tokens, n_known, base_score, score) of every text of ``streams``."""
    layout = model.layout
    asked = streams.select("shard", "stream", "lengths", "counted").mapInArrow(_wanted(layout, False), "tile long, shard string, keys binary, counts binary")
    answer = _answers(layout, model.discounts, model.strength, model.unit, [r for _, r in model.sides])
    answers = model_rows(model).groupBy("tile").cogroup(asked.groupBy("tile")).applyInArrow(answer, "shard string, tile long, scores binary")
    schema = "id long, counted boolean, n_tokens long, n_known long, base_score double, score double"
    return streams.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_documents(layout), schema)
