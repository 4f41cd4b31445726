"""Two tokenizers' ids of the same text put side by side, group by group, by divide and conquer at shared cuts.

Both token sequences spell the same bytes. Where a token of each ends at the same byte, both can be cut, and what
lies between neighbouring cuts is a group. An interval of a document is divided at the common end nearest its
middle: the middle end of the first tokenizer's tokens is looked up among the second's by bisection, then its
neighbours in windows that double on both sides; the halves are divided in turn, and an interval without a common
end inside is a leaf, one group. All open intervals of many documents are taken a level at a time in arrays, so depth
costs no recursion, and nothing crosses a document's ends.

The last tokens of a group are linked. A pair of ids that can be linked ends in the same bytes, so one of the two
spells an end of the other: there are at most as many such pairs as all tokens of both vocabularies have bytes, times
the tokens that spell the same. That bounds the table of counts, whatever the corpus; it is added up inside tasks first,
then by Spark, and read by tasks as a broadcast of at most that size.

A text that is null or empty, or whose tokens of either side spell something else, has no tokens and no groups. Rows that
share an id, have none or are repeated are aligned each for itself, and all count. Other columns are ignored; an empty
table gives an empty result. A text of any length is one row's arrays; texts are taken together up to ``_CHARS``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import pieces, tables
from heliograph.llm.byte_bpe import grouped
from heliograph.sources import storage

_CHARS = 1 << 19
# Words that a worker keeps of either side; they change no result.
_MEMO_A, MEMO = 500_000, 300_000
_WORDS = re.compile(" +[^ ]+| +")
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
SUMMED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
COUNTS = "a int, b int, n long"
FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteSide:
    """Byte-level BPE of a space and the text; the strings of special tokens are plain text. It spells every text."""

    def __init__(self, path: str):
        bytes_of = {c: bytes([b]) for b, c in pieces.byte_chars().items()}
        shape = pieces.settings(path)
        entries = shape["model"]["vocab"] | pieces.special_tokens(shape)
        if not bytes_of.keys() <= entries.keys():
            raise ValueError(f"{path} lacks single bytes")
        self._encoder = pieces.library_encoder(path, plain=True, memo=_MEMO_A)
        self.labels = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.labels[i] = b"".join(bytes_of.get(c, c.encode()) for c in entry)
        self.widths = np.array(list(map(len, self.labels)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._encoder.ids(f" {t}") for t in texts]


class PieceSide:
    """A sentencepiece model, which puts the space before the text itself.

    Where no piece has a space after another character, nothing is merged over that seam, and a text is the
    sequence of its words, each with the spaces before it. Words are then encoded once per worker, up to ``MEMO`` of
    them; those that are new in some texts go to the library together. Other models encode whole texts.
    """

    _MARK = "\u2581"
    _PROBE = " a  b\tc\nd   \u00e9 \ufb01 \u3000x  "  # spelled otherwise by models that normalise

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = model = SentencePieceProcessor(model_file=path)
        spelled = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.labels = [
            bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(self._MARK, " ").encode() for i, piece in enumerate(spelled)
        ]
        self.widths = np.array(list(map(len, self.labels)))
        self._memo: dict[str, bytes] = {}  # nothing where the ids spell something else
        self._unlike = False  # whether there was such a word
        seam = any(self._MARK in piece.lstrip(self._MARK) for piece in spelled)
        self._by_words = not seam and self._spelled(self._model.encode(self._PROBE), self._PROBE) is not None

    def _spelled(self, ids: list[int], text: str) -> bytes | None:
        """The ids as bytes, or None where they spell something else than a space and the text."""
        if b"".join(map(self.labels.__getitem__, ids)) != f" {text}".encode():
            return None
        return array("I", ids).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words and the space before each. Words that are spaces alone are encoded behind a letter."""
        first = len(self._model.encode("a"))
        encoded = self._model.encode([word if word.strip(" ") else f"a {word}" for word in words], num_threads=1)
        found = {word: self._spelled(ids if word.strip(" ") else ids[first:], word) or b"" for word, ids in zip(words, encoded)}
        self._unlike |= b"" in found.values()
        self._memo |= islice(found.items(), max(MEMO - len(self._memo), 0))
        return found

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, None where they do not spell it."""
        if not self._by_words:
            return [self._spelled(ids, text) for ids, text in zip(self._model.encode(texts, num_threads=1), texts)]
        words = [_words(text) for text in texts]
        get = self._memo.get
        found = [list(map(get, listed)) for listed in words]
        new = {word for listed, ids in zip(words, found) if None in ids for word, known in zip(listed, ids) if known is None}
        learnt = self._learn(list(new)) if new else {}
        out = []
        for text, listed, ids in zip(texts, words, found):
            if None in ids:
                ids = [known if known is not None else learnt[word] for word, known in zip(listed, ids)]
            spelled = self._MARK not in text and not (self._unlike and b"" in ids)
            out.append(b"".join(ids) if spelled else None)
        return out


def _words(text: str) -> list[str]:
    """The words of a space and the text without that space before each: spaces before a word belong to it, those at the
    end are one of their own."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [word[1:] for word in _WORDS.findall(f" {text}")]
    return text.split(" ")


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    """Once per Python worker."""
    return ByteSide(path_a), PieceSide(path_b)


def _windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def _nearest(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per interval of ``ends_a`` the index of the common end nearest its middle (-1 without one), and its index in
    ``ends_b``."""
    middle = (low + high) >> 1
    best, match = np.full(len(low), -1), np.full(len(low), -1)
    open_, reach = np.arange(len(low)), 0
    while len(open_):
        m, lo, hi = middle[open_], low[open_], high[open_]
        if reach:
            left, left_of = _windows(np.maximum(m - 2 * reach + 1, lo), m - reach + 1)
            right, right_of = _windows(m + reach, np.minimum(m + 2 * reach, hi))
            tried, owner = np.concatenate([left, right]), np.concatenate([left_of, right_of])
        else:
            tried, owner = m, np.arange(len(m))
        at = np.searchsorted(ends_b, ends_a[tried])
        hits = np.flatnonzero(ends_b[at] == ends_a[tried])
        if reach:
            hits = hits[np.argsort(-np.abs(tried[hits] - m[owner[hits]]), kind="stable")]  # the nearest is written last
        best[open_[owner[hits]]], match[open_[owner[hits]]] = tried[hits], at[hits]
        reach = 2 * reach or 1
        open_ = open_[(best[open_] < 0) & ((m - reach >= lo) | (m + reach < hi))]
    return best, match


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all common ends in both sides, ascending.

    ``ends`` are byte ends over all documents one after the other; ``last`` the index of each document's last token, which
    ends where the document does on both sides.
    """
    low, high = np.concatenate([[0], last_a[:-1] + 1]).astype(np.int64), last_a.astype(np.int64)
    b_low, b_high = np.concatenate([[0], last_b[:-1] + 1]).astype(np.int64), last_b.astype(np.int64)
    cuts_a, cuts_b = [high], [b_high]
    while True:
        inner = (low < high) & (b_low < b_high)
        low, high, b_low, b_high = low[inner], high[inner], b_low[inner], b_high[inner]
        if not len(low):
            break
        at, match = _nearest(ends_a, ends_b, low, high)
        cut = at >= 0
        at, match, low, high, b_low, b_high = at[cut], match[cut], low[cut], high[cut], b_low[cut], b_high[cut]
        cuts_a.append(at)
        cuts_b.append(match)
        # The halves stay in the order of the text, in which look-ups are quick.
        low, high = np.stack([low, at + 1], 1).ravel(), np.stack([at, high], 1).ravel()
        b_low, b_high = np.stack([b_low, match + 1], 1).ravel(), np.stack([match, b_high], 1).ravel()
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _aligned(ids: list[int | None], texts: list[str], a: ByteSide, b: PieceSide) -> pa.RecordBatch:
    b_packed = [packed if text else None for text, packed in zip(texts, b.encode(texts))]
    a_packed = a.encode(texts)
    packed = [(x, y) for x, y in zip(a_packed, b_packed) if y is not None]
    sides_ids = [np.frombuffer(b"".join(x), pieces.ID).astype(np.int32) for x in (zip(*packed) if packed else ((), ()))]
    filled = np.array([y is not None for y in b_packed], bool)
    bounds, ends = [], []
    for side, values, parts in zip((a, b), sides_ids, (a_packed, b_packed)):
        sizes = [len(x) // pieces.ID.itemsize if y is not None else 0 for x, y in zip(parts, b_packed)]
        bounds.append(np.cumsum([0, *sizes]))
        ends.append(np.cumsum(side.widths[values]))
    places = np.flatnonzero(filled)
    none = np.empty(0, np.int64)
    cuts = shared_cuts(*ends, bounds[0][places + 1] - 1, bounds[1][places + 1] - 1) if len(places) else (none, none)
    of_doc = np.searchsorted(cuts[0], bounds[0])
    columns = [_lists(values, bound) for values, bound in zip(sides_ids, bounds)]
    columns += [_lists(np.diff(c, prepend=-1), of_doc) for c in cuts]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])


def _over_texts(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str, then, schema: str) -> DataFrame:
    """``then`` of the alignment of every some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in grouped(list(map(len, texts)), _CHARS):
                yield then(_aligned(ids[begin:end], texts[begin:end], *both))

    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the ids of both sides, and how many of each are in every group."""
    return _over_texts(docs, path_a, path_b, id_column, text_column, lambda batch: batch, ALIGNED)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, and each row's bounds in them."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    return values, bounds - bounds[0]


@lru_cache(maxsize=4)
def _spellings(a_count: int, b_count: int) -> list[str]:
    """Decimal ids with what follows them: of the first side inside and at the end of a group, then of the second."""
    return [f"{i}{mark}" for count, marks in ((a_count, ",|"), (b_count, ",;")) for mark in marks for i in range(count)]


def group_texts(batch: pa.RecordBatch) -> Iterator[str]:
    """Per row its groups in decimal ids, ``a1,a2|b1;a3|b2,b3``."""
    (a, a_bounds), (b, b_bounds) = _flat(batch.column("a_ids")), _flat(batch.column("b_ids"))
    a_count, b_count = (1 << int(ids.max(initial=0)).bit_length() for ids in (a, b))  # few tables, whatever a batch holds
    spell = _spellings(a_count, b_count)
    (a_sizes, _), (b_sizes, _) = _flat(batch.column("a_sizes")), _flat(batch.column("b_sizes"))
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    codes = np.empty(len(a) + len(b), np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64) + 2 * a_count
    a_at = np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)
    b_at = np.arange(len(b)) + np.repeat(a_ends, b_sizes)
    a[a_ends - 1] += a_count
    b[b_ends - 1] += b_count
    codes[a_at], codes[b_at] = a, b
    bounds = (a_bounds + b_bounds).tolist()
    for begin, end in zip(bounds, bounds[1:]):
        yield "".join(map(spell.__getitem__, codes[begin:end].tolist()))[:-1]


def _summed(batch: pa.RecordBatch, narrow: bool) -> pa.RecordBatch:
    """Per row its tokens of both sides, its groups and their digest, and the links: pairs of unsigned 16-bit ids where
    all are narrow, else of 32 bits."""
    (a, a_bounds), (b, b_bounds) = _flat(batch.column("a_ids")), _flat(batch.column("b_ids"))
    (a_sizes, bounds), (b_sizes, _) = _flat(batch.column("a_sizes")), _flat(batch.column("b_sizes"))
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(batch)]
    links = np.stack([ids[np.cumsum(sizes) - 1] for ids, sizes in ((a, a_sizes), (b, b_sizes))], 1).astype("<u2" if narrow else "<u4")
    places = (bounds * links.strides[0]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(links))])
    counts = [pa.array(np.diff(x), pa.int64()) for x in (a_bounds, b_bounds, bounds)]
    columns = [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), packed]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SUMMED.split(", ")])


def summed(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its tokens of both sides, its groups and their digest, and the links: the last ids of every group."""

    def then(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _summed(batch, max(len(side.labels) for side in sides(path_a, path_b)) <= 1 << 16)

    return _over_texts(docs, path_a, path_b, id_column, text_column, then, SUMMED)


def _links(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows, some at a time, with their links as one key each, ``a`` in the high half, and each row's bounds in them."""
    for begin, end in grouped(batch.column("n_groups").to_pylist(), _CHARS):
        part = batch.slice(begin, end - begin)
        bounds = np.concatenate([[0], np.cumsum(part.column("n_groups").to_numpy())])
        data = b"".join(part.column("links").to_pylist())
        pairs = np.frombuffer(data, "<u2" if len(data) == 4 * bounds[-1] else "<u4").reshape(-1, 2).astype(np.int64)
        yield part, pairs[:, 0] << 32 | pairs[:, 1], bounds


def pair_counts(links: DataFrame) -> DataFrame:
    """How many links hold each pair of ids, over all documents of :func:`summed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, found, _ in (part for batch in batches for part in _links(batch)):
            new, n = np.unique(found, return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys):
            columns = pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)
            yield pa.RecordBatch.from_arrays(list(columns), names=["a", "b", "n"])

    tables.ship(links.sparkSession)
    partial = links.select("n_groups", "links").mapInArrow(run, COUNTS)
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def figures(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document of :func:`summed` its tokens, groups and links, the links that are the most frequent of their second
    id, the sum of their counts, and the digest of its groups.

    ``counts`` has a bound that the vocabularies set (see above), so it is broadcast to the tasks.
    """
    spark = links.sparkSession
    table = counts.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "n").orderBy("key").toArrow()
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    top = np.zeros(int((keys & 0xFFFFFFFF).max()) + 1 if len(keys) else 0, np.int64)
    np.maximum.at(top, keys & 0xFFFFFFFF, n)
    known = spark.sparkContext.broadcast((keys, n, top[keys & 0xFFFFFFFF] == n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for part, found, bounds in (part for batch in batches for part in _links(batch)):
            at, groups = np.searchsorted(keys, found), part.column("n_groups").to_numpy()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds]) for x in (best.astype(np.int64), n)]
            figures = [pa.array(x, pa.int64()) for x in (groups, groups, *sums)]
            arrays = [*(part.column(c) for c in ("doc_id", "n_a", "n_b")), *figures, part.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FIGURES.split(", ")])

    tables.ship(spark)
    return links.mapInArrow(run, FIGURES)


def align_and_count(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`figures` of all documents; the links are written once and read for the counts and the figures."""
    links = storage.checkpoint(summed(docs, path_a, path_b, id_column, text_column))
    return figures(links, storage.checkpoint(pair_counts(links)))
