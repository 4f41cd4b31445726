"""Words by scans, fill-in-the-middle and shared cuts against the libraries and brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from heliograph.llm import alignment, byte_bpe, fill_middle, pieces, text_queries

RANKS, BYTES, PIECES = (pieces.vocabulary(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    made = []
    for chars in (" \n'srvel t1!", "  \n\t ab1'!é😀\x1c\x85sthe", "'sstrevemlld x"):
        made += ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    wide = [32, 10, 39, *range(33, 127), *range(0xA0, 0x250), 0x2003, 0x3000, 0x4E2D, 0x1F600, 0x1C89]
    made += ["".join(chr(rnd.choice(wide)) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    return made + ["a" * 900, " " * 60 + "x", "-" * 999, "very" * 900, "'", "'r", "'l", "'ll", "'re", "'ll 's", "x  ", "<|endoftext|>"]


def test_ids_equal_the_library(texts, library):
    coder = byte_bpe.load(RANKS)
    for text, (ids, numbers) in zip(texts, coder.encode_each(texts), strict=True):
        want = library.encode_ordinary(text)
        assert np.frombuffer(ids, pieces.ID).tolist() == want, text
        assert numbers.decode() == " ".join(map(str, want))


@pytest.mark.parametrize("window", [1, 7, 300])
def test_windows_change_nothing(texts, library, monkeypatch, window):
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    for text, (ids, _) in zip(texts[::40], byte_bpe.load(RANKS).encode_each(texts[::40]), strict=True):
        assert np.frombuffer(ids, pieces.ID).tolist() == library.encode_ordinary(text)


def test_scan_equals_stepping_one_by_one():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 256, 257, 5000):
        classes = rng.integers(0, byte_bpe._CLASSES, size).astype(np.uint8)
        state, want = byte_bpe.WHITE_N, []
        for kind in classes.tolist():
            want.append(state)
            state = byte_bpe._step(state, kind)[0]
        got, last = byte_bpe.states_before(classes, byte_bpe.WHITE_N)
        assert got.tolist() == want and last == state


def test_words_equal_the_pattern(texts):
    for text in texts:
        begins = byte_bpe.cuts(f"{text}\n", np.array([len(text)])).tolist()[:-1]
        if "Ᲊ" not in text:  # newer than the tables of the pattern module
            assert begins == [m.start() for m in regex.finditer(PATTERN, text)]


def test_offsets_tell_which_ids_cover_a_part(texts):
    coder, rnd = byte_bpe.load(RANKS), random.Random(1)
    for text, (packed, _) in zip(texts[::20], coder.encode_each(texts[::20])):
        ids, data = np.frombuffer(packed, pieces.ID).tolist(), text.encode()
        offsets = coder.offsets(ids).tolist() if ids else [0]
        assert offsets[-1] == len(data) and coder.decode(ids) == data
        for _ in range(5):
            begin, end = sorted(rnd.randint(0, len(data)) for _ in range(2))
            assert coder.decode_part(ids, offsets, begin, end) == data[begin:end]


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip_rows(odd_docs, no_docs, library):
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r.text or "")
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), r.text or "")]
        want.append((r.doc_id, len(ids), *sums))
    assert _sorted(byte_bpe.round_trip(odd_docs, RANKS).collect()) == _sorted(want)
    assert byte_bpe.round_trip(no_docs, RANKS).count() == 0
    tokens = byte_bpe.encode(odd_docs, RANKS)
    assert _sorted((r.doc_id, r.ids) for r in tokens.collect()) == _sorted((r.doc_id, library.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    back = byte_bpe.decode(tokens, RANKS).collect()
    assert _sorted((r.doc_id, bytes(r.data)) for r in back) == _sorted((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect())


def test_skip_list_reaches_every_rank():
    rnd = random.Random(5)
    for size in (0, 1, 2, 5, 64, 3000):
        widths = [rnd.randint(1, 90) for _ in range(size)]
        units, before = fill_middle.SkipList(widths), 0
        for rank in range(size + 1):
            offset, steps = units.seek(rank)
            assert offset == before and steps <= 60
            before += widths[rank] if rank < size else 0
        with pytest.raises(IndexError):
            units.seek(size + 1)


def _brute_middle(doc_id, text):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    psm, spm = f"<P>{pre}<S>{suf}<M>{mid}", f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "spm" if h4 % 100 < 50 else "psm", len(pre), len(mid), spm if h4 % 100 < 50 else psm


def _line_texts():
    rnd = random.Random(8)
    made = ["".join(rnd.choice("\n\nab<S>PMé😀") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    return made + ["\n", "\n\n", "a\n", "\na", "x<P>", "<S\n>", "a<\n\n<", "z" * 3000, "line\n" * 4000, None]


def test_middles_equal_brute_force(spark, odd_docs, no_docs):
    rows = list(enumerate(_line_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, odd_docs):
        changed = fill_middle.transform(frame)
        back = fill_middle.restored(changed["output"], changed["form"]).alias("back")
        got = changed.select("*", back).collect()
        want = [(r.doc_id, *_brute_middle(r.doc_id, r.text or ""), r.text or "") for r in frame.select("doc_id", "text").collect()]
        assert _sorted(got) == _sorted(want)
        assert {r.form for r in got} >= ({"plain", "psm", "spm"} if frame is docs else {"plain"})
    assert fill_middle.transform(no_docs).count() == 0


def test_middle_sql_equals_brute_force():
    import pandas as pd

    documents = pd.DataFrame(enumerate(_line_texts()), columns=["doc_id", "text"])  # noqa: F841  (read by name)
    got = duckdb.sql(text_queries.MIDDLE_SQL).fetchall()
    want = []
    for doc_id, text in enumerate(_line_texts()):
        *head, output = _brute_middle(doc_id, text or "")
        want.append((doc_id, *head, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, text or ""))))
    assert _sorted(got) == _sorted(want)


def _brute_align(rows):
    """Figures by sets of ends, straight from the libraries' tokens."""
    stand_ins = {c: b for b, c in pieces.byte_chars().items()}
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def ends(labels):
        return np.cumsum([len(x) for x in labels]).tolist()

    found, counts = [], Counter()
    for doc_id, text in rows:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(stand_ins[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not text or any(b"".join(x) != f" {text}".encode() for x in (a_bytes, b_bytes)):
            found.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        shared = sorted(set(a_ends) & set(b_ends))
        links = [(a[a_ends.index(e)], b[b_ends.index(e)]) for e in shared]
        groups = [
            ([i for i, e in zip(a, a_ends) if x < e <= y], [i for i, e in zip(b, b_ends) if x < e <= y])
            for x, y in zip([0, *shared], shared)
        ]
        counts.update(links)
        found.append((doc_id, a, b, links, groups))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, a, b, links, groups in found:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        top = sum(counts[link] == best[link[1]] for link in links)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), top, sum(counts[x] for x in links), digest))
    return out


def test_alignment_equals_brute_force(spark, odd_docs, no_docs, prose, monkeypatch):
    rnd = random.Random(9)
    made = ["".join(rnd.choice("  ab ing the1é日😀▁<s>\n") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    rows = list(enumerate([*made, prose("xx", 300), prose("yy", 300), "x" * 700, "日本語" * 50, "<|endoftext|> </s> <unk> <0x41>", None]))
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    assert _sorted(alignment.align_and_count(docs, BYTES, PIECES).collect()) == _sorted(_brute_align(rows))
    odd = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 9000]
    frame = odd_docs.filter("coalesce(length(text), 0) < 9000")
    assert _sorted(alignment.align_and_count(frame, BYTES, PIECES).collect()) == _sorted(_brute_align(odd))
    assert alignment.align_and_count(no_docs, BYTES, PIECES).count() == 0


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 400):
        for share in (0.05, 0.5, 0.95):
            ends_a, ends_b, last_a, last_b, base = [], [], [], [], 0
            for _ in range(6):
                total = size + int(rng.integers(0, size + 1))
                for ends, last in ((ends_a, last_a), (ends_b, last_b)):
                    inner = np.flatnonzero(rng.random(total - 1) < share) + 1
                    ends += [base + int(x) for x in inner] + [base + total]
                    last.append(len(ends) - 1)
                base += total
            both = sorted(set(ends_a) & set(ends_b))
            a, b = alignment.shared_cuts(*(np.array(x) for x in (ends_a, ends_b, last_a, last_b)))
            assert [ends_a[i] for i in a] == both == [ends_b[i] for i in b]
