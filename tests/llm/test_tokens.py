import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veritab.llm import bpe, output, packing, queries

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "m", "d", "A", "é", "ñ", "1", "²", "٣", "!", "..", "_", "中", "日本", "😀", "\u0085", "Σ", "ΑΣ",
         "İ", "e\u0301", "ﬁ", "<|endoftext|>", "<|startoftext|>", "x" * 70, "\x00", "\u200b", "ǅ", "\u0300", "'S", "'Re", "\x1c", " the", "ing"]
ODD = [None, "", " ", "\n\n", "word " * 4000, "y" * 3000, "the end<|endoftext|> of it"]


def made(n):
    r = random.Random(11)
    return ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_and_texts_equal_the_library(path):
    texts = [t or "" for t in ODD] + made(4000)
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for a, b, ids, bounds in own.encode(texts):
        want = [e.ids for e in library.encode_batch(texts[a:b], add_special_tokens=False)]
        assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == want
        decoded = [library.decode(i, skip_special_tokens=False).encode() for i in want]
        assert own.decode(ids, bounds) == decoded


def test_characters_newer_than_pythons_tables_equal_the_library():
    import sys

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    new = np.flatnonzero(bpe.unassigned())
    texts = [f"a{chr(i)}b {chr(i)} x{chr(i)}" for i in [0x1C89, 0xA7CB, *new[new < 0x20000][::97].tolist()] if not 0xD800 <= i < 0xE000]
    texts += ["plain", "", "é"]
    for a, b, ids, bounds in bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts):
        for i, t in enumerate(texts[a:b]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert bpe.holding_unassigned(texts) >= {0, 1} and len(texts) - 1 not in bpe.holding_unassigned(texts) and sys.maxunicode


def test_a_full_word_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BITS", 6)
    own, library = bpe.Encoder(WORD), Tokenizer.from_file(WORD)
    for text in ("a few words", " ".join(f"w{i}" for i in range(900)), "a few words more"):
        [(_, _, ids, _)] = own.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_digests(spark):
    texts = ODD + made(300)
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encoding_digests(frame, WORD).collect())) == sorted(want)
    both = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_and_decode(frame, WORD).collect()}
    assert both[4][1] == library.decode(both[4][0], skip_special_tokens=False) and both[0] == ([], "")


def pieces_of(rows, limit=1024):
    library, out = Tokenizer.from_file(BYTE), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        while at < len(ids):
            size = (len(ids) % limit or limit) if at == 0 and len(ids) > limit else min(limit, len(ids))
            out.append((i, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    return out


def test_packing_holds_every_piece_once(spark):
    rows = list(enumerate(ODD + made(400) + ["word " * n for n in range(0, 3000, 37)])) + [(1, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack(frame, BYTE).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces_of(rows))
    total = 0
    for sequence in {r["sequence_id"] for r in got}:
        mine = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == sequence)
        at = 0
        for offset, length in mine:
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len({r["sequence_id"] for r in got}) <= -(-total // 1024) + 1


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(frame, BYTE).collect() == []
    assert bpe.encoding_digests(frame, WORD).collect() == []
    assert output.sequence_digests(output.packed_sequences(frame, BYTE)).collect() == []


def bins_exact(lengths, limit):
    """Fewest bins of a few pieces, by trying all ways."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*rooms, limit - lengths[k]])

    place(0, [])
    return best[0]


def test_fixed_bins_never_cost_a_bin():
    r = random.Random(2)
    for _ in range(300):
        limit = r.choice([10, 13, 20])
        lengths = [r.randint(1, limit) for _ in range(r.randint(1, 9))]
        counts = np.bincount(lengths, minlength=limit + 1)
        fixed = packing.reduce_by_dominance(counts, limit)
        rest = [x for x in range(limit + 1) for _ in range(counts[x])]
        assert sum(t for t, _ in fixed) + (bins_exact(rest, limit) if rest else 0) == bins_exact(lengths, limit), (limit, lengths)


def test_capacity_tree_finds_the_smallest_that_fits():
    r, tree, open_rooms = random.Random(1), output.CapacityTree(50), []
    for _ in range(500):
        room = r.randint(0, 50)
        open_rooms.append(room)
        tree.change(room, 1)
        if r.random() < 0.5:
            gone = open_rooms.pop(r.randrange(len(open_rooms)))
            tree.change(gone, -1)
        size = r.randint(0, 50)
        assert tree.at_least(size) == min((x for x in open_rooms if x >= size), default=None)


def test_matrices_give_the_documents_back(spark, tmp_path):
    rows = list(enumerate(ODD + made(200) + ["word " * n for n in range(0, 3000, 97)]))
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, starts int")
    output.write_matrices(output.packed_sequences(frame, BYTE), str(tmp_path / "m"))
    raw = spark.read.parquet(str(tmp_path / "m")).collect()
    library, got = Tokenizer.from_file(BYTE), {}
    for r in raw:
        assert len(r["input_ids"]) == len(r["positions"]) == 4096
        places, bounds = np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        ids = np.frombuffer(r["input_ids"], "<u4")
        assert bounds[0] == 0 and bounds[-1] == r["n_tokens"] <= 1024
        for a, b, doc, start in zip(bounds, bounds[1:], r["doc_ids"], r["starts"]):
            assert places[a:b].tolist() == list(range(b - a))
            got.setdefault(doc, {})[start] = ids[a:b].tolist()
    for i, t in rows:
        whole = [x for start in sorted(got[i]) for x in got[i][start]]
        assert whole == library.encode(t or "", add_special_tokens=False).ids + [2]
    cut = output.read_matrices(spark, str(tmp_path / "m")).collect()
    assert all(len(r["input_ids"]) == 4 * r["n_tokens"] for r in cut)


def test_query_writes_the_matrices_and_reads_them(spark, monkeypatch):
    written, write = [], output.write_matrices
    monkeypatch.setattr(output, "write_matrices", lambda sequences, path: (written.append(path), write(sequences, path)))
    got = queries.QUERIES["op5_packed_matrices"](spark, "/root/testdata/sf0.001").collect()
    raw = {r["sequence_id"]: r for r in spark.read.parquet(*written).collect()}
    assert len(got) == len(raw) > 0
    for r in got:
        m, bounds = raw[r["sequence_id"]], [*r["cu_seqlens"], 1024]
        assert r["ids_crc32"] == zlib.crc32(m["input_ids"][: 4 * r["n_tokens"]]) and r["cu_seqlens"] == m["cu_seqlens"]
        places = np.concatenate([np.arange(b - a) for a, b in zip(bounds, bounds[1:])])
        assert r["positions_crc32"] == zlib.crc32(places.astype("<u4").tobytes())


def test_no_documents_give_empty_matrices(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    output.write_matrices(output.packed_sequences(frame, BYTE), str(tmp_path / "m"))
    assert output.matrix_digests(spark, str(tmp_path / "m")).collect() == []
