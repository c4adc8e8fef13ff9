"""Near duplicates by Jaccard similarity of word shingles: an exact join through a token-group matrix.

Method: sets are partitioned into groups of similar ones (equal smallest token, at most ``GROUP``
members). For each group the matrix holds the union of its members' tokens, stored over hashed token
columns as one bit vector of at least twice as many bits as a member has tokens. How many tokens a
query can share with any member is at most its size less its columns that the group lacks; only
groups that can reach the threshold are opened, and there the query is compared with every member
exactly.

Which (query, group) entries are looked at at all follows from prefixes: with all tokens in one order,
two sets that link share a token among the first n - ceil(t n) + 1 of each. Frequent tokens come last
in that order, so lists of rare tokens are short. Sets that are almost wholly made of frequent tokens
(large families of near copies) are linked to central members first; after that only queries whose
family isn't connected yet are held against the groups that share a frequent token with them.

Equal sets are one set, named by a 64-bit hash of its tokens. Tokens are 64-bit hashes of shingles.
Texts are shingled again in each pass, which is cheaper than keeping or moving their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from veritab.llm import words as W
from veritab.llm.bloom import BlockedBloom
from veritab.llm.components import components
from veritab.llm.dedup import one_row_of
from veritab.llm.spread import lookup_by_size
from veritab.session import few_tasks, materialize

SIZE = 5
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tokens in at least so many sets are frequent. Any order is right; this one bounds lists.
FREQUENT = 64
#: At most so many frequent tokens (the most frequent ones) are known to every task: 8 MB.
FREQUENT_MAX = 1 << 20
GROUP = 64
#: Sets of which the unions of groups are made by one task, about.
UNION_SETS = 20_000
#: Code points that a task shingles at once.
CHUNK = 400_000
#: Tokens that a task holds at once when it opens groups, about.
OPEN_TOKENS = 1 << 20
#: Tokens that count as one row where tasks are sized by ``few_tasks``.
ROW_TOKENS = 10
STAR_KEYS = 4
#: Sets that a task remembers, to pass each on once; forgetting only costs repeated rows.
REMEMBERED = 500_000


def shingle_sets(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, one text after the other, and their bounds.

    A-Z are lower-cased; words are what lies between white space. A text with fewer words than
    ``size`` has one shingle, its whole sequence; one without words has none.
    """
    points, starts = W.code_points(texts)
    points = np.where((points >= 0x41) & (points <= 0x5A), points + np.uint32(0x20), points)
    inside = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    fresh = np.zeros(len(points) + 1, bool)
    fresh[starts] = True
    before, behind = np.ones(len(points), bool), np.ones(len(points), bool)
    before[1:], behind[:-1] = ~inside[:-1], ~inside[1:]
    begin = np.flatnonzero(inside & (before | fresh[:-1]))
    end = np.flatnonzero(inside & (behind | fresh[1:])) + 1
    hashes = W.word_hashes(points, begin, end)
    text = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count

    def folded(at: np.ndarray, n: int) -> np.ndarray:
        total = hashes[at]
        for k in range(1, n):
            total = total * W.BASE + hashes[at + k]
        return W.mix(total + np.uint64(n))

    whole = np.flatnonzero(np.arange(len(begin)) - first[text] + size <= count[text])
    tokens, owner = [folded(whole, size)], [text[whole]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        tokens.append(folded(first[short], n))
        owner.append(short)
    token, text = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[keep], text[keep]
    return token, np.searchsorted(text, np.arange(len(texts) + 1))


def set_names(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(token ^ W.BASE), dtype=np.uint64)])
    return W.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of size n must share with any set it links to."""
    return -(-PERCENT * n // 100)


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Tokens that two sets of these sizes must share to link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _sets(batches: Iterator[pa.RecordBatch], wanted: Callable | None = None) -> Iterator[tuple]:
    """Each set that a task has not met yet: tokens, bounds, names and sizes, chunk by chunk."""
    met: set[int] = set()
    for batch in batches:
        for a, b, texts in W.text_chunks(batch.column("text"), CHUNK):
            token, bounds = shingle_sets(texts)
            size = np.diff(bounds)
            names = set_names(token, bounds)
            new = np.zeros(b - a, bool)
            if len(met) > REMEMBERED:
                met.clear()
            for i, name in enumerate(names.tolist()):
                if size[i] and name not in met:
                    met.add(name)
                    new[i] = True
            yield batch, a, b, token, bounds, names, size, new if wanted is None else new & wanted(names)


def _picked(token: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the chosen sets, the set of each (its place in ``which``), and its place in the set."""
    size = np.diff(bounds)[which]
    picked = W.ragged(token, bounds[:-1][which], size)
    owner = np.repeat(np.arange(len(which)), size)
    return picked, owner, np.arange(len(picked)) - np.repeat(np.cumsum(size) - size, size)


def columns_of(token: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> list[bytes]:
    """The bit vector of each chosen set: a power of two of columns, at least twice its size."""
    own, owner, _ = _picked(token, bounds, which)
    size = np.diff(bounds)[which]
    width = 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    start = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), bool)
    bits[start[owner] + (own & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    data = np.packbits(bits, bitorder="little").tobytes()
    return [data[a // 8 : (a + w) // 8] for a, w in zip(start.tolist(), width.tolist())]


def folded_to(columns: np.ndarray, size: int) -> np.ndarray:
    """The same set over fewer columns."""
    return np.bitwise_or.reduce(columns.reshape(-1, size), axis=0) if len(columns) > size else columns


def described(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, text_hash, n, set name; per set once in a task also its least token and columns."""
    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, token, bounds, names, size, new in _sets(batches):
            empty, which = size == 0, np.flatnonzero(new)
            least = np.zeros(b - a, np.int64)
            least[~empty] = token[bounds[:-1][~empty]].view(np.int64)
            columns: list[bytes | None] = [None] * (b - a)
            for i, data in zip(which.tolist(), columns_of(token, bounds, which)):
                columns[i] = data
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id")[a:b], batch.column("text_hash")[a:b], pa.array(size.astype(np.int64)),
                    pa.array(names, mask=empty), pa.array(least, mask=~new), pa.array(columns, pa.binary()),
                ],
                ["id", "text_hash", "n", "name", "least", "columns"],
            )

    schema = f"id {id_type}, text_hash long, n long, name long, least long, columns binary"
    return rows.mapInArrow(run, schema)


def short_keys(token: np.ndarray, parts: int) -> np.ndarray:
    """Tokens for counting: a part, and 40 bits within it. Two that meet only move the order a little."""
    low = token & np.uint64((1 << 40) - 1)
    return (token >> np.uint64(40)) % np.uint64(parts) << np.uint64(40) | low


def frequent_tokens(text: DataFrame, parts: int, tokens: int) -> np.ndarray:
    """Sorted ``short_keys`` of the frequent tokens, counted over all sets, which hold about so many ``tokens``.

    Tokens travel in packs of 5 bytes each, one pack per part and chunk.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, token, bounds, _, _, new in _sets(batches):
            keys = np.sort(short_keys(_picked(token, bounds, np.flatnonzero(new))[0], parts))
            part = (keys >> np.uint64(40)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            low = keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            packs = [low[5 * x : 5 * y] for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(packs, pa.binary())], ["part", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint8).reshape(-1, 5)
        keys = np.zeros((len(data), 8), np.uint8)
        keys[:, :5] = data
        found, times = np.unique(keys.view(np.uint64).ravel(), return_counts=True)
        often = times >= FREQUENT
        whole = found[often] | np.uint64(table["part"][0].as_py() << 40)
        return pa.table({"key": pa.array(whole.view(np.int64)), "sets": pa.array(times[often])})

    packed = text.mapInArrow(pack, "part long, tokens binary")
    counted = few_tasks(packed.groupBy("part").applyInArrow(count, "key long, sets long"), tokens // ROW_TOKENS)
    most = counted.orderBy(F.desc("sets"), "key").limit(FREQUENT_MAX).select("key").toArrow()
    return np.sort(most["key"].to_numpy().view(np.uint64))


def _ordered(token: np.ndarray, bounds: np.ndarray, which: np.ndarray, frequent: np.ndarray, parts: int) -> tuple:
    """Prefixes of the chosen sets: token, set, size of the set, place, frequent or not; rare ones of each."""
    own, owner, _ = _picked(token, bounds, which)
    size = np.diff(bounds)[which]
    keys = short_keys(own, parts)
    often = np.zeros(len(own), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        often = frequent[at] == keys
    order = np.argsort(2 * owner + often, kind="stable")
    first = np.cumsum(size) - size
    place = np.arange(len(own)) - np.repeat(first, size)
    keep = place < np.repeat(size - least_overlap(size) + 1, size)
    rare = size - np.bincount(owner, weights=often, minlength=len(which)).astype(np.int64)
    return own[order][keep], owner[keep], place[keep], often[order][keep], size, rare, own, owner, often


def sized(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Size and place in one number, which halves what a posting carries besides its names."""
    return n.astype(np.int64) << 32 | place


def rare_postings(text: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, token, bounds, names, _, new in _sets(batches):
            which = np.flatnonzero(new)
            own, owner, place, often, size, *_ = _ordered(token, bounds, which, frequent.value, parts)
            own, owner, place = own[~often], owner[~often], place[~often]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array(names[which][owner]), pa.array(sized(size[owner], place))],
                ["token", "name", "sized"],
            )

    return text.mapInArrow(run, "token long, name long, sized long")


def frequent_postings(text: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    """Of sets whose prefix holds frequent tokens: those (key null), and star keys (key 0, 1, ...).

    A star key is the smallest of the set's frequent tokens under one of several orders; ``place``
    is then the number of its rare tokens, few for central members of a family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, token, bounds, names, _, new in _sets(batches):
            which = np.flatnonzero(new)
            own, owner, place, often, size, rare, every, holder, common = _ordered(
                token, bounds, which, frequent.value, parts
            )
            own, owner, place = own[often], owner[often], place[often]
            out = [(own.view(np.int64), names[which][owner], size[owner], place, np.full(len(own), -1))]
            stars = np.unique(owner)
            mine = common & np.isin(holder, stars)
            for k in range(STAR_KEYS):
                drawn = W.mix(every[mine] ^ np.uint64(0x9E3779B9 * (k + 1)))
                least = np.full(len(which), np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, holder[mine], drawn)
                out.append((least[stars].view(np.int64), names[which][stars], size[stars], rare[stars], np.full(len(stars), k)))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "name", "n", "place", "star"])

    return text.mapInArrow(run, "token long, name long, n long, place long, star long")


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the lists of rows sorted by token that pass the size and place filters."""
    left: list[np.ndarray] | None = None

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, name, both = columns
        n, place = both >> 32, both & 0xFFFFFFFF
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name, n, place = token[fresh], name[fresh], n[fresh], place[fresh]
        found, step = [], 1
        live = np.flatnonzero(token[1:] == token[:-1]) if len(token) else np.zeros(0, np.int64)
        while len(live):
            other = live + step
            rest = np.minimum(n[live] - place[live], n[other] - place[other])  # this token and all behind it
            good = rest >= least_common(n[live], n[other])
            found.append(np.stack([name[live[good]], name[other[good]]], axis=1))
            step += 1
            live = live[live + step < len(token)]
            live = live[token[live + step] == token[live]]
        ends = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if left is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(left, columns)]
        if not len(columns[0]):
            continue
        whole = np.searchsorted(columns[0], columns[0][-1])  # the last list may go on
        left = [c[whole:] for c in columns]
        if whole:
            yield pairs([c[:whole] for c in columns])
    if left is not None:
        yield pairs(left)


class Matrix:
    """Groups of the given sets, the union of each group's columns, and how to open a group."""

    def __init__(self, sets: DataFrame, text: DataFrame):
        """``sets``: name, n, least, columns; one row each."""
        self.text = text
        share = F.ceil(F.col("members") / GROUP).cast("long")
        self.rows = sets.count()
        families = materialize(few_tasks(sets.groupBy("least").agg(F.count("*").alias("members")), self.rows))
        grouped = lookup_by_size(sets, families, "least", "members", self.rows).select(
            "name", "n", F.xxhash64("least", F.pmod(F.xxhash64("name"), share)).alias("group"), "columns"
        )
        self.sets = materialize(few_tasks(grouped, self.rows))
        buckets = 1 + self.rows // UNION_SETS
        bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket")
        unions = (
            self.sets.select(bucket, "group", "n", "columns").groupBy("bucket")
            .applyInArrow(_unions, "group long, least_n long, union_columns binary")
        )
        self.unions = materialize(few_tasks(unions, self.rows))

    def qualifying(self, entries: DataFrame, rows: int) -> DataFrame:
        """Of (query, group), about so many ``rows``, those where the bound allows a link."""
        queries = self.sets.select(F.col("name").alias("query"), "n", "columns")
        both = entries.join(queries, "query").join(self.unions, "group")
        both = few_tasks(both.select("query", "group", "n", "columns", "least_n", "union_columns"), rows)
        return both.mapInArrow(_within_bound, "query long, group long")

    def links(self, entries: DataFrame, rows: int) -> DataFrame:
        """(a, b) of all links between queries and members of the groups that qualify; about so many ``rows`` of entries."""
        opened = materialize(self.qualifying(entries, rows))
        if opened.isEmpty():
            return opened.select(F.col("query").alias("a"), F.col("query").alias("b"))
        members = self.sets.select("group", "name", "n").join(opened.select("group").distinct(), "group")
        members = materialize(few_tasks(members, self.rows))
        wanted = opened.select(F.col("query").alias("name")).unionByName(members.select("name")).distinct()
        wanted = materialize(few_tasks(wanted, self.rows))
        tokens = materialize(few_tasks(tokens_of(self.text, wanted), self.rows))
        # Requests of a group are dealt to as many shares as keep a share's tokens few.
        sized = opened.join(self.sets.select(F.col("name").alias("query"), "n"), "query")
        shares = sized.groupBy("group").agg(F.sum("n").alias("tokens"), F.count("*").alias("requests"))
        shares = shares.withColumn("shares", F.ceil(F.col("tokens") / OPEN_TOKENS).cast("long"))
        shares = materialize(few_tasks(shares, self.rows))
        load = shares.agg(F.sum("tokens")).first()[0] or 0
        load += members.join(shares, "group").agg(F.sum(F.col("n") * F.col("shares"))).first()[0] or 0
        buckets = 1 + load // OPEN_TOKENS
        bucket = F.pmod(F.xxhash64("group", "share"), F.lit(buckets)).alias("bucket")
        requests = (
            lookup_by_size(opened, shares, "group", "requests", opened.count())
            .select("query", "group", F.pmod(F.xxhash64("query"), "shares").alias("share"))
            .join(tokens.select(F.col("name").alias("query"), "tokens"), "query")
            .select(bucket, "group", "share", F.col("query").alias("name"), F.col("tokens").alias("data"))
        )
        held = (
            members.join(shares.select("group", "shares"), "group")
            .select("group", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
            .join(tokens, "name")
            .select(bucket, *[F.col(c).alias(c) for c in ("group", "share", "name")], F.col("tokens").alias("data"))
        )
        found = requests.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_open_groups, "a long, b long")
        return few_tasks(found, int(load) // ROW_TOKENS)


def _unions(table: pa.Table) -> pa.Table:
    """Per group the smallest size and the union of columns, over as many as its smallest set has."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for group, n, data in zip(*(table[c].to_pylist() for c in ("group", "n", "columns"))):
        columns = np.frombuffer(data, np.uint8)
        if group in found:
            least, union = found[group]
            size = min(len(union), len(columns))
            n, columns = min(n, least), folded_to(union, size) | folded_to(columns, size)
        found[group] = n, columns
    return pa.table({
        "group": pa.array(list(found), pa.int64()),
        "least_n": pa.array([n for n, _ in found.values()], pa.int64()),
        "union_columns": pa.array([c.tobytes() for _, c in found.values()], pa.binary()),
    })


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (query, group) rows that the bound on their overlap leaves."""
    for batch in batches:
        good = []
        for n, least, own, union in zip(*(batch.column(c).to_pylist() for c in ("n", "least_n", "columns", "union_columns"))):
            columns, group = np.frombuffer(own, np.uint8), np.frombuffer(union, np.uint8)
            size = min(len(columns), len(group))
            lacking = folded_to(columns, size) & ~folded_to(group, size)
            most = n - int(np.bitwise_count(lacking).sum())
            good.append(100 * most >= PERCENT * n and (100 + PERCENT) * most >= PERCENT * (n + least))
        kept = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("query", "group")], ["query", "group"])


def _open_groups(requests: pa.Table, held: pa.Table) -> pa.Table:
    """Compare every query with the members of its group, once the union of their tokens allows it."""

    def rows(table: pa.Table) -> dict[tuple[int, int], list[tuple[int, np.ndarray]]]:
        out: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for group, share, name, data in zip(*(table[c].to_pylist() for c in ("group", "share", "name", "data"))):
            out.setdefault((group, share), []).append((name, np.frombuffer(data, np.uint64)))
        return out

    groups = rows(held)
    found: list[np.ndarray] = []
    for key, queries in rows(requests).items():
        members = groups.get(key, [])
        if not members:
            continue
        names = np.array([name for name, _ in members])
        size = np.array([len(t) for _, t in members])
        every = np.concatenate([t for _, t in members])
        owner = np.repeat(np.arange(len(members)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        union, times = every[first], np.diff(np.append(first, len(every)))
        for name, query in queries:
            at = np.minimum(np.searchsorted(query, union), len(query) - 1)
            shared = query[at] == union
            if 100 * shared.sum() < PERCENT * len(query):
                continue
            common = np.bincount(owner[np.repeat(shared, times)], minlength=len(members))
            good = (100 * common >= PERCENT * (len(query) + size - common)) & (names != name)
            if good.any():
                found.append(np.stack([np.full(good.sum(), name), names[good]], axis=1))
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.table({"a": both[:, 0].copy(), "b": both[:, 1].copy()})


def tokens_of(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, tokens) of the wanted sets. A Bloom filter of bounded size keeps most others back."""
    bloom = text.sparkSession.sparkContext.broadcast(BlockedBloom.of(wanted.select(F.col("name").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, token, bounds, names, _, new in _sets(batches, lambda names: bloom.value.may_hold(names.view(np.uint64))):
            which = np.flatnonzero(new)
            packs = [token[bounds[i] : bounds[i + 1]].tobytes() for i in which]
            yield pa.RecordBatch.from_arrays([pa.array(names[which]), pa.array(packs, pa.binary())], ["name", "tokens"])

    found = text.mapInArrow(run, "name long, tokens binary")
    return found.join(wanted, "name", "left_semi").dropDuplicates(["name"])


def _star_pairs(hot: DataFrame) -> DataFrame:
    """Each set with the most central set of each of its star keys."""
    stars = hot.filter("star >= 0").select(F.xxhash64("star", "token").alias("key"), "name", "place", "n")
    share, total = F.col("place") / F.col("n"), stars.count()
    central = stars.groupBy("key").agg(F.min_by("name", F.struct(share, F.col("name"))).alias("center"), F.count("*").alias("rows"))
    central = materialize(few_tasks(central, total))
    pairs = lookup_by_size(stars.select("key", "name"), central.filter("rows > 1"), "key", "rows", total)
    return pairs.filter("name <> center").select(F.least("name", "center").alias("a"), F.greatest("name", "center").alias("b"))


def _open_entries(hot: DataFrame, member: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """(query, group) that share a frequent prefix token and are not known to be connected, and the number of postings.

    On each token the sets of its largest component need no query of their own: whatever links to
    them from another component asks for their groups. An entry is due on the first token that two
    sets share, so what lies behind it in either set must still be enough for a link.
    """
    postings = hot.filter("star < 0").select("token", "name", "n", (F.col("n") - F.col("place")).alias("rest"))
    rows = postings.count()
    postings = postings.join(member, "name", "left").withColumn("component", F.coalesce("component", "name"))
    postings = materialize(few_tasks(postings.join(sets.select("name", "group"), "name"), rows))
    counts = postings.groupBy("token", "component").agg(F.count("*").alias("sets"))
    largest = counts.groupBy("token").agg(
        F.max_by("component", F.struct("sets", "component")).alias("largest"), F.count("*").alias("components")
    )
    largest = largest.filter("components > 1").select("token", "largest")
    asking = (
        postings.join(largest, "token").filter("component <> largest")
        .select("token", F.col("name").alias("query"), F.col("component").alias("own"), "n", F.col("rest").alias("own_rest"))
    )
    groups = postings.groupBy("token", "group", "component").agg(F.max("rest").alias("rest"), F.min("n").alias("least_n"))
    enough = (100 + PERCENT) * F.least("own_rest", "rest") >= PERCENT * (F.col("n") + F.col("least_n"))
    due = asking.join(groups, "token").filter((F.col("own") != F.col("component")) & enough).select("query", "group").distinct()
    return due, rows


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, and text_hash (xxhash64 of the text).

    component_id is the smallest id that links reach. A null text counts as empty; a text without
    words has no shingles, links with nothing and is its own component. Repeated rows are equal
    sets. A row without an id takes part and gets its component's smallest id, null if there is none.
    """
    spark = documents.sparkSession
    text = documents.select(F.col(text_col).alias("text"))
    stored = materialize(described(documents, id_col, text_col))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stored.filter("least IS NOT NULL")  # a set once in a task
    n_sets, n_tokens = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(frequent_tokens(text, parts, n_tokens))
    hot = materialize(frequent_postings(text, frequent, parts))
    n_postings = n_tokens * (100 - PERCENT) // 100 + n_sets
    lists = few_tasks(rare_postings(text, frequent, parts).repartition("token"), n_postings // ROW_TOKENS)
    lists = lists.sortWithinPartitions("token", "name")
    pairs = lists.mapInArrow(_list_pairs, "a long, b long").unionByName(_star_pairs(hot))
    pairs = materialize(few_tasks(pairs.distinct(), n_postings // ROW_TOKENS))
    named = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
    active = materialize(few_tasks(named.unionByName(hot.select("name")).distinct(), n_sets))
    sets = known.select("name", "n", "least", "columns").join(active, "name", "left_semi")
    matrix = Matrix(materialize(few_tasks(sets.dropDuplicates(["name"]), n_sets)), text)
    entries = pairs.select(F.col("a").alias("query"), "b").join(
        matrix.sets.select(F.col("name").alias("b"), "group"), "b"
    )
    links = materialize(matrix.links(entries.select("query", "group").distinct(), pairs.count()))
    member = materialize(few_tasks(components(links).withColumnRenamed("id", "name"), n_sets))
    more = matrix.links(*_open_entries(hot, member, matrix.sets))
    final = components(materialize(links.unionByName(more)))
    classes = stored.filter("name IS NOT NULL").groupBy("name").agg(
        F.min(F.col("id").cast("long")).alias("least_id"), F.count("*").alias("rows")
    )
    classes = classes.join(final.withColumnRenamed("id", "name"), "name", "left").withColumn(
        "component", F.coalesce("component", "name")
    )
    classes = materialize(few_tasks(classes, n_sets))
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    result = classes.join(smallest, "component").select("name", "rows", "component_id")
    result = materialize(few_tasks(result, n_sets))
    rows = stored.select("id", "text_hash", F.col("n").alias("n_shingles"), "name")
    some = rows.filter("name IS NOT NULL")
    linked = lookup_by_size(some, result, "name", "rows", some.count()).drop("name", "rows")
    alone = rows.filter("name IS NULL").drop("name").withColumn("component_id", F.col("id").cast("long"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", "text_hash")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose id is their component's smallest, with all their columns.

    Rows that stand there several times with the same id and text stay once.
    """
    marked = materialize(near_duplicates(documents, id_col, text_col))
    kept: Column = F.col(id_col).cast("long").eqNullSafe(F.col("component_id"))
    named = marked.select(F.col(id_col).alias("_0"), F.col("text_hash").alias("_1"), kept.alias("kept"))
    several = named.filter("kept AND _0 IS NOT NULL").groupBy("_0", "_1").agg(F.count("*").alias("rows")).filter("rows > 1")
    several = materialize(several.select("_0", "_1"))
    gone = materialize(named.filter("NOT kept").select("_0", "_1").unionByName(several).distinct())
    # The hash of a null text is a number too, so only ids may be null here.
    same = documents[id_col].eqNullSafe(gone["_0"]) & (F.xxhash64(text_col) == gone["_1"])
    left = documents.join(gone, same, "left_anti")
    return left.unionByName(one_row_of(documents, [F.col(id_col), F.xxhash64(text_col)], several))
