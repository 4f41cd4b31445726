"""Byte-level BPE whose words are found without regular expressions, by scans over arrays of code points.

Every code point has one of a dozen classes (letter, digit, white space, the letters of contractions, ...), and
every class is a function from the states of a small automaton to its states. Such functions compose
associatively, so the state before each code point comes from a prefix scan: blocks are composed side by side,
the blocks' products are scanned by doubling, and each block starts from what came before it. State and class
tell where words begin; a white-space run and a contraction cut in two are decided one code point later. Windows
of ``WINDOW`` code points hand the state on, so a text of any length takes bounded memory beside itself.

The slices between boundaries are encoded by merging the adjacent pair of lowest rank until none is left, and kept
in a memo of at most ``MEMO`` short words, which changes no result. Byte offsets of all ids are kept: they tell
which ids cover a part of the text, and ids decode to the bytes between them.

Null and empty texts have no ids. Rows that share an id, rows with a null id and repeated rows are encoded each for
itself; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import pieces, tables

MEMO = 500_000
_MEMO_BYTES = 64  # longer words are merged each time
WINDOW = 1 << 20
_BLOCK = 256
_CHARS = 1 << 20  # code points of documents that are scanned together

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>, offsets array<long>"

# Classes of code points. BREAK stands between documents.
LETTER, DIGIT, OTHER, WHITE, SPACE, QUOTE, ONE, R, V, E, L, BREAK = range(12)
_CLASSES = 12
# States: before any word; in a run; after a quote that begins a word, and its first letter; after white space,
# by whether it ends in a space and whether it is longer than one.
FRESH, WORD, NUMBER, SIGNS, QUOTED, QUOTED_E, QUOTED_L, SPACE_1, WHITE_1, SPACE_N, WHITE_N = range(11)
_STATES = 11
HERE, BEFORE = 1, 2  # a word begins at this code point; at the one before


def _after_break(kind: int) -> tuple[int, int]:
    """Next state and boundary where a word begins with this class."""
    state = {DIGIT: NUMBER, OTHER: SIGNS, QUOTE: QUOTED, SPACE: SPACE_1, WHITE: WHITE_1}.get(kind, WORD)
    return state, HERE


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and where words begin."""
    white = kind in (SPACE, WHITE)
    if kind == BREAK:
        return FRESH, BEFORE if state in (QUOTED_E, QUOTED_L) else 0
    if state in (QUOTED_E, QUOTED_L):
        if kind == (E if state == QUOTED_E else L):
            return FRESH, 0
        following, found = _step(WORD, kind)
        return following, found | BEFORE
    if state == QUOTED and kind in (ONE, R, V, L):
        return {ONE: FRESH, L: QUOTED_L}.get(kind, QUOTED_E), 0
    if state in (QUOTED, SIGNS) and kind in (OTHER, QUOTE):
        return SIGNS, 0
    if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
        if white:
            return SPACE_N if kind == SPACE else WHITE_N, 0
        last = BEFORE if state in (SPACE_N, WHITE_N) else 0
        following, found = _after_break(kind)
        if state in (WHITE_1, WHITE_N):
            return following, found | last
        return SIGNS if kind == QUOTE else following, last  # the space belongs to the word after it
    following, found = _after_break(kind)
    return following, 0 if (state, following) in ((WORD, WORD), (NUMBER, NUMBER)) else found


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions, numbered: followed by a class, by another one, applied to a
    state; and what is found by state and class. Number 0 changes nothing."""
    steps = [[_step(s, c) for s in range(_STATES)] for c in range(_CLASSES)]
    single = [tuple(state for state, _ in step) for step in steps]
    numbers = {tuple(range(_STATES)): 0}
    queue = list(numbers)
    for function in queue:
        for step in single:
            composed = tuple(step[s] for s in function)
            if composed not in numbers:
                numbers[composed] = len(numbers)
                queue.append(composed)
    extend = np.array([[numbers[tuple(step[s] for s in f)] for step in single] for f in queue], np.uint16)
    compose = np.array([[numbers[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
    found = np.array([[steps[c][s][1] for c in range(_CLASSES)] for s in range(_STATES)], np.uint8)
    return extend, compose, np.array(queue, np.uint8), found


def states_before(classes: np.ndarray, start: int = FRESH) -> tuple[np.ndarray, int]:
    """The automaton's state before each code point, and after the last, by a prefix scan of functions."""
    extend, compose, apply, _ = _functions()
    count = len(classes)
    blocks = max(1, -(-count // _BLOCK))
    padded = np.full(blocks * _BLOCK, BREAK, np.uint8)
    padded[:count] = classes
    by_place = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T).astype(np.uint16)
    inside = np.empty((_BLOCK, blocks), np.uint16)
    so_far, flat = np.zeros(blocks, np.uint16), extend.ravel()
    for place in range(_BLOCK):
        inside[place] = so_far
        so_far = flat.take(so_far * np.uint16(_CLASSES) + by_place[place])
    products, reach = so_far, 1
    while reach < blocks:  # doubling: each block's product takes in those of the blocks before it
        products = np.concatenate([products[:reach], compose[products[:-reach], products[reach:]]])
        reach *= 2
    entry = np.full(blocks, start, np.uint8)
    entry[1:] = apply[products[:-1], start]
    states = apply.ravel().take(inside * np.uint16(_STATES) + entry).T.ravel()[:count]
    return states, int(apply[extend[inside.T.ravel()[count - 1], classes[-1]], entry[-1]]) if count else start


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """Class by code point. Letters, digits and white space are those of the library whose words are wanted, asked
    once per worker: its Unicode tables may be newer than Python's."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", WHITE)):
        single = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        members = single.decode_bytes(single.encode_ordinary(every)).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), "<u4")] = kind
    for chars, kind in (("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
        classes[[ord(c) for c in chars]] = kind
    return classes


def cuts(text: str, breaks: np.ndarray) -> np.ndarray:
    """Code point indices where a word begins, and of the breaks between documents, ascending.

    ``breaks`` are the places of one code point each that belongs to no document; the last closes the text.
    """
    classes_of, (*_, found_by) = code_classes(), _functions()
    found = np.zeros(len(text) + 1, np.bool_)
    state = FRESH
    for begin in range(0, len(text), WINDOW):
        codes = np.frombuffer(text[begin : begin + WINDOW].encode("utf-32-le"), "<u4")
        classes = classes_of.take(codes)
        low, high = np.searchsorted(breaks, [begin, begin + len(codes)])
        classes[breaks[low:high] - begin] = BREAK
        states, state = states_before(classes, state)
        marks = found_by.ravel().take(states * np.uint8(_CLASSES) + classes)
        found[begin : begin + len(codes)] |= (marks & HERE).astype(bool)
        late = np.flatnonzero(marks & BEFORE) + begin - 1
        found[late] = True
    found[breaks] = True
    return np.flatnonzero(found)


def merge_pairs(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of lowest rank, the first of equals, is merged until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    gone = bytearray(size)
    while heap:
        _, i, end = heappop(heap)
        middle = after[i]
        if gone[i] or middle >= size or after[middle] != end:
            continue
        after[i], gone[middle] = end, 1
        if end < size:
            before[end] = i
            if (rank := ranks.get(word[i : after[end]])) is not None:
                heappush(heap, (rank, i, after[end]))
        if i and (rank := ranks.get(word[before[i] : end])) is not None:
            heappush(heap, (rank, before[i], end))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


class ByteBpe:
    """Encoding and decoding by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks = ranks
        self._labels = [b""] * (max(ranks.values()) + 1)
        for label, i in ranks.items():
            self._labels[i] = label
        self._widths = np.array(list(map(len, self._labels)), np.int64)
        self._memo: dict[bytes, tuple[bytes, bytes]] = {}

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian bytes, and as decimal numbers."""
        ids = merge_pairs(word, self._ranks)
        kept = np.array(ids, pieces.ID).tobytes(), " ".join(map(str, ids)).encode()
        if len(self._memo) < MEMO and len(word) <= _MEMO_BYTES:
            self._memo[word] = kept
        return kept

    def encode_each(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Per text its ids as little-endian bytes, and as decimal numbers with a space between."""
        joined = "\n".join(["", *texts, ""])
        breaks = np.cumsum([0, *(len(t) + 1 for t in texts)])
        places = cuts(joined, breaks)
        data = joined.encode()
        if len(data) != len(joined):
            starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            begins = starts[places].tolist()
        else:
            begins = places.tolist()
        first = np.searchsorted(places, breaks).tolist()
        get = self._memo.get
        for a, b in zip(first, first[1:]):
            at = begins[a + 1 : b + 1]
            words = [data[i:j] for i, j in zip(at, at[1:])]
            found = [kept or self._word(word) for word, kept in zip(words, map(get, words))]
            yield b"".join([ids for ids, _ in found]), b" ".join([numbers for _, numbers in found])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id in the text, and the text's length at the end."""
        return np.concatenate([[0], np.cumsum(self._widths[ids])])

    def decode(self, ids) -> bytes:
        return b"".join(map(self._labels.__getitem__, ids))

    def decode_part(self, ids: list[int], offsets: list[int], begin: int, end: int) -> bytes:
        """The bytes from ``begin`` to ``end`` of the text, from the ids that cover them alone."""
        low, high = max(bisect_right(offsets, begin) - 1, 0), bisect_left(offsets, end)
        return self.decode(ids[low:high])[begin - offsets[low] : end - offsets[low]] if low < high else b""


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """From a file of base64 labels and ranks, once per Python worker."""
    with open(path, "rb") as file:
        return ByteBpe({base64.b64decode(label): int(rank) for label, rank in map(bytes.split, file)})


def grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that come to about ``most`` together; a larger one stands alone."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _mapper(path: str, row, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in grouped(list(map(len, texts)), _CHARS):
                rows = [(i, *row(coder, *found)) for i, found in zip(ids[a:b], coder.encode_each(texts[a:b]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    tables.ship(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the ids of the whole text, and each id's byte offset in it (with the length at the end)."""

    def row(coder: ByteBpe, packed: bytes, numbers: bytes):
        ids = np.frombuffer(packed, pieces.ID)
        return ids, coder.offsets(ids)

    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return _rows(docs, id_column, text_column).mapInArrow(_mapper(path, row, ["doc_id", "ids", "offsets"], types), TOKENS)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            data = [coder.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    tables.ship(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids in decimal and digest of the bytes they decode to."""

    def row(coder: ByteBpe, packed: bytes, numbers: bytes):
        ids = np.frombuffer(packed, pieces.ID).tolist()
        return len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _rows(docs, id_column, text_column).mapInArrow(_mapper(path, row, names, types), DIGEST)
