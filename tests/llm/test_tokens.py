"""Record files, merge automaton and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from heliograph.llm import bpe, packing, pieces, records, tables

PATH = pieces.vocabulary()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    narrow = " \n\t ab1'!é😀\x1c\x85sthe"
    made = ["".join(rnd.choice(narrow) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    wide = [32, 10, 39, *range(33, 127), *range(0xA0, 0x250), 0x2003, 0x3000, 0x4E2D, 0x1F600]
    made += ["".join(chr(rnd.choice(wide)) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    return made + ["a" * 500, " " * 60 + "x", "-" * 999, "x  <|endoftext|> y", "<|endoftext|>", "'ll 's"]


def test_encoders_equal_the_library(texts, library):
    automaton, own = bpe.load(PATH)
    cached = pieces.library_encoder(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for text in texts:
        ids = library(text)
        assert np.frombuffer(own.ids(text), pieces.ID).tolist() == ids
        assert np.frombuffer(cached.ids(text), pieces.ID).tolist() == ids
        assert automaton.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_merged_sequences():
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "aa": 4, "abc": 5, "bc": 6}
    table = bpe.compile_merges(vocab, [("a", "b"), ("a", "a"), ("ab", "c"), ("b", "c")], {})
    automaton = bpe.Automaton(table)
    merged = {"aaa": ["aa", "a"], "aab": ["a", "ab"], "abc": ["abc"], "bc": ["bc"], "abab": ["ab", "ab"], "aabc": ["a", "abc"], "cbc": ["c", "bc"]}
    for word, want in merged.items():
        assert [table.labels[t].decode() for t in automaton.encode(word.encode())] == want


def test_memo_bound_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 3)
    encoder = pieces.TextEncoder(pieces.library_encoder(PATH)._encode_word, {})
    text = "many different words, many of them twice, words of them"
    for _ in range(2):
        assert np.frombuffer(encoder.ids(text), pieces.ID).tolist() == library(text)


def test_round_trip_rows(odd_docs, no_docs, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd_docs, PATH).collect())
    want = []
    for r in odd_docs.collect():
        ids = np.array(library(r.text), "<u4")
        sums = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), *sums))
    assert got == sorted(want)
    assert bpe.round_trip(no_docs, PATH).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd_docs.collect())


def test_checksum_vectors():
    assert records.crc32c(b"123456789") == 0xE3069283
    assert records.crc32c(bytes(32)) == 0x8A9136AA
    assert records.crc32c(b"a") == 0xC1D04330
    data = random.Random(1).randbytes(3 * 4096 + 2)
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    assert records.crc32c(data) == state ^ 0xFFFFFFFF


def test_frames():
    ids = np.array([0, 1, 70000], "<u4").tobytes()
    for doc_id, body in ((5, ids), (None, ids[:8]), (-1, b"")):
        framed = records.frame(records.payload(doc_id, body))
        got_id, got = records.parse(records.unframe(framed))
        assert got_id == doc_id and got.tobytes() == body
        for k in range(len(framed)):
            damaged = framed[:k] + bytes([framed[k] ^ 1]) + framed[k + 1 :]
            with pytest.raises(ValueError):
                records.unframe(damaged)


def test_record_files(spark, odd_docs, no_docs, library):
    manifest = records.write(odd_docs, tables.scratch_dir(spark, "records"), PATH)
    got = sorted(map(tuple, records.read(spark, manifest).collect()), key=lambda r: r[1])
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    at = 0
    for doc_id, start, n_tokens, checksum in got:
        ids = np.array([*library(texts[doc_id]), 0], "<u4")
        assert (start, n_tokens, checksum) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == odd_docs.count()
    for row in manifest.collect():
        file = records.RecordFile(row.file)
        in_order = [(d, x.tolist()) for d, x in file]
        assert len(file) == row.n_records
        shuffled = list(range(len(file)))
        random.Random(2).shuffle(shuffled)
        for k in shuffled:
            doc_id, x = file[k]
            assert (doc_id, x.tolist()) == in_order[k]
    assert records.read(spark, records.write(no_docs, tables.scratch_dir(spark, "records"), PATH)).count() == 0


def check_packing(rows, docs, library, length):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    copies = {}
    for r in docs:
        copies.setdefault(r.doc_id, []).append(r.text)
    total = 0
    for doc_id, same in copies.items():
        ids = [*library(same[0]), 2]
        total += len(ids) * len(same)
        want = []
        first = len(ids) % length or length
        bounds = [0, *range(first, len(ids) + 1, length)]
        for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want += [(number, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] * len(same)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == sorted(want)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence), -(-total // length)


def test_packing(odd_docs, no_docs, library):
    rows = packing.pack(packing.cut(odd_docs, PATH)).collect()
    used, least = check_packing(rows, odd_docs.collect(), library, packing.LENGTH)
    assert used <= least + 1
    small = packing.pack(packing.cut(odd_docs, PATH, length=16), size=16, group=50).collect()
    check_packing(small, odd_docs.collect(), library, 16)
    assert packing.pack(packing.cut(no_docs, PATH)).count() == 0


def test_bins_of_all_groups_meet_again(spark, library):
    """The surplus does not grow with the number of groups."""
    rnd = random.Random(6)
    rows = [(i, rnd.randint(250, 420)) for i in range(4000)]
    parts = spark.createDataFrame(rows, "doc_id long, length long").repartition(5)
    least = -(-sum(n for _, n in rows) // packing.LENGTH)
    used = {}
    for again in (0, packing.AGAIN):
        packed = packing.pack(parts, group=250, again=again).collect()
        fills = {}
        for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fills.get(r.sequence_id, 0)
            fills[r.sequence_id] = r.offset + r.length
        assert sorted((r.doc_id, r.length) for r in packed) == rows and max(fills.values()) <= packing.LENGTH
        used[again] = len(fills)
    one = len({r.sequence_id for r in packing.pack(parts, group=4000).collect()})
    assert least <= used[packing.AGAIN] <= one + 2 and used[packing.AGAIN] < used[0]


def test_clashing_columns_are_kept_or_replaced(spark):
    rows = [(i, 100 + i, "a", "b") for i in range(20)]
    parts = spark.createDataFrame(rows, "doc_id long, length long, _group string, _piece_key string")
    packed = packing.pack(parts.selectExpr("*", "'x' AS offset"))
    assert packed.columns == ["doc_id", "length", "_group", "_piece_key", "sequence_id", "offset"]
    assert {(r._group, r._piece_key) for r in packed.collect()} == {("a", "b")} and packed.count() == 20


def test_checksums_of_many_parts():
    rnd = random.Random(3)
    payloads = [rnd.randbytes(n) for n in (0, 1, 3, 4, 5, 9, 4095, 4096, 4097, 9000, *range(10, 60))]
    framed, index = records.frame_all(payloads)
    for p, entry in zip(payloads, index):
        body = bytes(framed[entry["offset"] : entry["offset"] + len(p) + 16])
        length = len(p).to_bytes(8, "little")
        want = length + records.masked(records.crc32c(length)).to_bytes(4, "little") + p + records.masked(records.crc32c(p)).to_bytes(4, "little")
        assert body == want
    assert records.unframe_all(bytes(framed), index) == payloads
    for at in (0, 9, len(framed) - 1, len(framed) // 2):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe_all(bytes(broken), index)


def test_shared_files_need_a_file_system(spark, tmp_path):
    assert tables.qualified(spark, str(tmp_path)).startswith("file:/")
    assert tables.shared_files(tables.qualified(spark, str(tmp_path)))[1] == str(tmp_path)
    with pytest.raises(ValueError):
        tables.shared_files("/user/x")


def test_sequences_hold_the_ids(odd_docs, library):
    packed = packing.pack(packing.cut(odd_docs, PATH, with_ids=True))
    rows, filled = packed.collect(), {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, filled.values())) == sum(r.length for r in rows)
    for r in rows:
        assert filled[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)


@pytest.mark.parametrize("low, high", [(250, 420), (300, 1024), (1, 600), (1024, 1024)])
def test_local_search_never_needs_more_than_best_fit(low, high):
    rnd = random.Random(9)
    lengths = [rnd.randint(low, high) for _ in range(600)]
    place, offset = packing.pack_lengths(lengths)
    fills = {}
    for p, o, n in sorted(zip(place, offset, lengths)):
        assert o == fills.get(p, 0)
        fills[p] = o + n
    plain = packing.Bins(packing.LENGTH)
    for n in sorted(lengths, reverse=True):
        plain.put(0, n, plain.tightest(n))
    assert max(fills.values()) <= packing.LENGTH and len(fills) <= len(plain.items)


def test_two_for_one_empties_a_bin():
    # Best fit leaves three bins; giving 30 + 30 for 50 lets everything fit into two.
    lengths = [50, 50, 40, 30, 30]
    place, _ = packing.pack_lengths(lengths, 100)
    assert len(set(place)) == 2
