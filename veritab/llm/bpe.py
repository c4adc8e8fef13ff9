"""Byte-pair encoding and decoding of whole texts with a public tokenizer file.

Method: contiguous rank arrays. A short word is a row of part ids and of the ranks of adjacent
pairs. The smallest rank is looked for, its boundary is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Rows of many words are handled together as arrays. Each
worker keeps a bounded table of words that it has seen, so that the work per text is a lookup.

Words of over ``SHORT`` bytes, where scanning again and again would be quadratic, and texts that
hold a special token's string go to the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from veritab.llm import words as W

SHORT = 48
#: Words of like widths are handled together, padded with NO_PART.
WIDTHS = [0, 6, 9, 14, SHORT]
NO_PART = np.int32(-1)
NO_RANK = np.int32(2**31 - 1)
#: A worker's table of known words has 2**21 entries, half of them used at most.
TABLE_BITS = 21
APOSTROPHE = 0x27


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def unassigned() -> np.ndarray:
    """Code points that this Python's Unicode tables do not know; the library's may be newer."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


def holding_unassigned(texts: list[str]) -> set[int]:
    """The texts that hold such a code point."""
    if all(map(str.isascii, texts)):
        return set()
    points, starts = W.code_points(texts)
    return set((np.searchsorted(starts, np.flatnonzero(unassigned()[points]), side="right") - 1).tolist())


def _runs(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one class: start, end, class, and whether a text begins there."""
    kind = W.classes()[points]
    first = np.zeros(len(points), bool)
    first[starts[:-1][starts[:-1] < len(points)]] = True
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(points)), kind[start], first[start]


def _contractions(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophe runs that take letters of the next run, and how many: 's 't 'm 'd 're 've 'll."""
    at = np.flatnonzero((end - start == 1) & (points[start] == APOSTROPHE))
    at = at[at + 1 < len(start)]
    at = at[(kind[at + 1] == W.LETTER) & ~first[at + 1]]
    one = points[start[at + 1]]
    two = points[np.minimum(start[at + 1] + 1, len(points) - 1)]
    long_enough = end[at + 1] - start[at + 1] >= 2
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = long_enough & (
        (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    )
    taken = np.where(single, 1, np.where(double, 2, 0))
    return at[taken > 0], taken[taken > 0]


def spaced_words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of words that carry one blank before them; nothing of a text is left out."""
    start, end, kind, first = _runs(points, starts)
    if not len(start):
        return start, end
    begin, stop = start.copy(), end.copy()
    space = np.flatnonzero((kind[:-1] == W.SPACE) & ~first[1:])  # white space before a word
    blank = points[end[space] - 1] == 0x20
    stop[space[blank]] -= 1
    begin[space[blank] + 1] -= 1
    alone = space[~blank & (end[space] - start[space] >= 2)]
    stop[alone] -= 1
    at, taken = _contractions(points, start, end, kind, first)
    free = begin[at] == start[at]
    at, taken = at[free], taken[free]
    stop[at] += taken
    begin[at + 1] += taken
    begin = np.concatenate([begin, end[alone] - 1])
    stop = np.concatenate([stop, end[alone]])
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], stop[order]
    some = stop > begin
    return begin[some], stop[some]


def bare_words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of words without white space; every number character is a word of its own."""
    start, end, kind, first = _runs(points, starts)
    if not len(start):
        return start, end
    begin, stop = start.copy(), end.copy()
    at, taken = _contractions(points, start, end, kind, first)
    stop[at] += taken
    begin[at + 1] += taken
    number = kind == W.NUMBER
    digits = W.ragged(np.arange(len(points)), start[number], end[number] - start[number])
    keep = (kind != W.SPACE) & ~number & (stop > begin)
    begin, stop = np.concatenate([begin[keep], digits]), np.concatenate([stop[keep], digits + 1])
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order]


class Encoder:
    """One tokenizer file: ids of texts, and texts of ids."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lowers = content["normalizer"] is not None
        self.special = [x["content"] for x in content["added_tokens"]]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = W.Table(18)
        self.pairs.add(W.mix(left << np.uint64(32) | right), np.arange(len(merges), dtype=np.int32))
        letters = byte_alphabet()
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + self.suffix, -1) for b in range(256)], np.int32)
        tokens = [""] * (max(vocab.values(), default=-1) + 1)
        for token, number in vocab.items():
            tokens[number] = token
        for x in content["added_tokens"]:
            tokens.extend([""] * (x["id"] + 1 - len(tokens)))
            tokens[x["id"]] = x["content"]
        self.joins_with_blank = content["decoder"] is None
        self.token_text = _Pool([t.encode() + b" " for t in tokens])
        self.token_number = _Pool([b"%d " % i for i in range(len(tokens))])
        self._forget()

    def _forget(self) -> None:
        self.known = W.Table(TABLE_BITS)
        self.word_ids = np.zeros(0, np.uint32)
        self.word_start = np.zeros(0, np.int64)
        self.word_length = np.zeros(0, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = W.mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        found = self.pairs.find(keys.ravel()).reshape(keys.shape)
        return np.where(found < 0, NO_RANK, found)

    def _merge(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part ids (words x parts) of equally long words to final ids, -1 behind the last."""
        out = np.full(parts.shape, -1, np.int32)
        row = np.arange(len(parts))
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            least = ranks.argmin(axis=1)
            live = ranks[np.arange(len(row)), least] != NO_RANK
            if not live.all():
                out[row[~live], : parts.shape[1]] = parts[~live]
                row, parts, ranks, least = row[live], parts[live], ranks[live], least[live]
            if not len(row):
                break
            i = np.arange(len(row))
            rank = ranks[i, least]
            place = np.arange(parts.shape[1] - 1, dtype=np.int32)[None, :]
            parts = np.where(place > least[:, None], parts[:, 1:], parts[:, :-1])
            parts[i, least] = self.merged[rank]
            ranks = np.where(place[:, :-1] >= least[:, None], ranks[:, 1:], ranks[:, :-1])
            before = np.flatnonzero(least > 0)
            ranks[before, least[before] - 1] = self._rank(parts[before, least[before] - 1], parts[before, least[before]])
            after = np.flatnonzero(least < parts.shape[1] - 1)
            ranks[after, least[after]] = self._rank(parts[after, least[after]], parts[after, least[after] + 1])
        if len(row):
            out[row, : parts.shape[1]] = parts
        return out, (out >= 0).sum(axis=1)

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode distinct unknown words and keep their ids."""
        chars = W.ragged(points, start, end - start)
        data = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(wide)])[np.cumsum(end - start)]
        length = np.diff(np.concatenate([[0], ends]))
        begin = ends - length
        ids: list[np.ndarray] = []
        count = np.zeros(len(start), np.int32)
        order = []
        long = np.flatnonzero(length > SHORT)
        for i in long:
            word = "".join(map(byte_alphabet().__getitem__, data[begin[i] : ends[i]].tolist()))
            one = np.array([t.id for t in self.library.model.tokenize(word)], np.uint32)
            ids.append(one)
            count[i] = len(one)
        order.append(long)
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            which = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(which), 8192):
                some = which[at : at + 8192]
                place = np.arange(length[some].max())[None, :]
                inside = place < length[some][:, None]
                raw = data[np.where(inside, begin[some][:, None] + place, 0)]
                parts = np.where(inside, self.inner[raw], NO_PART)
                row = np.arange(len(some))
                parts[row, length[some] - 1] = self.last[raw[row, length[some] - 1]]
                out, n = self._merge(parts)
                ids.append(out[out >= 0].astype(np.uint32))
                count[some] = n
                order.append(some)
        places = np.concatenate(order)
        at = np.zeros(len(start), np.int64)
        at[places] = len(self.word_ids) + np.cumsum(count[places]) - count[places]
        self.known.add(hashes, np.arange(len(self.word_start), len(self.word_start) + len(start), dtype=np.int32))
        self.word_ids = np.concatenate([self.word_ids, *ids])
        self.word_start = np.concatenate([self.word_start, at])
        self.word_length = np.concatenate([self.word_length, count])

    def _normal(self, text: str) -> str:
        if not self.lowers:
            return text
        text = unicodedata.normalize("NFC", text)
        # One character at a time, as the library does; it matters for the final sigma only.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = W.code_points(list(map(self._normal, texts)))
        begin, end = (bare_words if self.lowers else spaced_words)(points, starts)
        hashes = W.word_hashes(points, begin, end)
        row = self.known.find(hashes)
        if (missing := np.flatnonzero(row < 0)).size:
            new, first = np.unique(hashes[missing], return_index=True)
            if self.known.full(len(new)):
                self._forget()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
                if self.known.full(len(new)):
                    self.known = W.Table(int(4 * len(new)).bit_length())
            first = missing[first]
            self._learn(points, begin[first], end[first], new)
            row = self.known.find(hashes)
        length = self.word_length[row]
        ids = W.ragged(self.word_ids, self.word_start[row], length)
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, total[np.searchsorted(begin, starts)]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges [a, b) of ``texts``: all their ids, and where each text's begin, with the end."""
        for a, b in W.chunks(texts):
            some = texts[a:b]
            strange = sorted({i for i, t in enumerate(some) if any(s in t for s in self.special)} | holding_unassigned(some))
            plain = some if not strange else ["" if i in set(strange) else t for i, t in enumerate(some)]
            ids, bounds = self._encode_some(plain)
            if strange:
                pieces = np.split(ids, bounds[1:-1])
                for i in strange:
                    pieces[i] = np.array(self.library.encode(some[i], add_special_tokens=False).ids, np.uint32)
                ids = np.concatenate(pieces).astype(np.uint32)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            yield a, b, ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids: tokens joined by one blank, as without a decoder."""
        if not self.joins_with_blank:
            return [self.library.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(bounds, bounds[1:])]
        return self.token_text.joined(ids, bounds)

    def numbers(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Decimal ids of each run, joined by one blank."""
        return self.token_number.joined(ids, bounds)


class _Pool:
    """Byte strings that end in a blank, to be joined by ids."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.length = np.fromiter(map(len, items), np.int32, len(items))
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        length = self.length[ids]
        data = W.ragged(self.data, self.start[ids], length).tobytes()
        at = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[bounds].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


@cache
def encoder(path: str) -> Encoder:
    """Each worker reads a tokenizer file once."""
    return Encoder(path)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def encode_and_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``ids`` (array of int) and ``decoded`` (text of the ids).

    A null text counts as empty and has no ids. Repeated rows each give a row. No shuffle. The
    path must be readable on every executor.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, bounds in encoder(path).encode(texts_of(batch, text_col)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = pa.array([d.decode() for d in encoder(path).decode(ids, bounds)])
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[a:b], lists, decoded], ["id", "ids", "decoded"])

    return documents.select(id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoding_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_tokens, and digests of its ids and of their decoded text.

    A null text counts as empty and has no tokens. Repeated rows are encoded each for itself, null ids stay,
    other columns are not read, and no documents give no rows. The digests are taken where the ids are made, so that ids never leave the task.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def digests(items: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, bounds in encoder(path).encode(texts_of(batch, text_col)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col)[a:b],
                        pa.array(np.diff(bounds)),
                        digests(encoder(path).numbers(ids, bounds)),
                        digests(encoder(path).decode(ids, bounds)),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
