"""Documents cut into pieces and packed into sequences of a fixed length, with a local search over bins.

A document's ids end with an end id; only those longer than a sequence are cut, so that all pieces but the
first are whole sequences. Pieces are dealt into groups of bounded size by a running number, whatever their
document or source, and each group is packed by itself. First every piece, longest first, goes into the fullest
bin it fits. Then the emptiest bins give away pieces: a piece moves to another underfull bin, or one or two
pieces change places with a shorter one there. Only changes that increase the sum of squared fills are made,
which drains the emptiest bins until they are gone; a group stops when its pieces need every bin it has left
or ``PATIENCE`` bins in a row could not be emptied. The pieces of each group's ``AGAIN`` emptiest bins are dealt out
and packed anew, round after round, until they are one group: a bin too many is left once, not once in every group.
Nothing is dropped or reordered inside a document.

Null and empty texts are a piece of one end id; a text of any length is cut in one row. Rows that share an id, have
none or are repeated are separate documents to the packing. ``cut`` ignores other columns, ``pack`` carries them along.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import pieces, tables
from heliograph.sources import storage

LENGTH = 1024
END_ID = 2
GROUP = 16_384  # pieces packed together
AGAIN = 64  # emptiest bins of each group whose pieces are packed once more, with those of other groups
PATIENCE = 32  # emptiest bins in a row that could not be emptied, after which a group stops
ROUNDS = 4  # passes over the other bins for one of them
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "piece_key long, length long, sequence_id long, offset long, again boolean"
MOST_IDS = 1 << 20  # in a batch that a task hands on
_MOST_ROUNDS = 64  # each leaves a hundredth of the pieces open


def _cutter(path: str, length: int, end_id: int, with_ids: bool, memo: int | None = None):
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    types |= {"ids": pa.list_(pa.int32())} if with_ids else {}

    def handed_on(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = pieces.library_encoder(path, memo=memo), np.array([end_id], pieces.ID).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encoder.ids(text.as_py()) + end, pieces.ID)
                bounds = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[a:b]
                    row = (doc_id, number, a, b - a, zlib.crc32(part.tobytes()))
                    rows.append((*row, part) if with_ids else row)
                    held += b - a
                    if held >= MOST_IDS:
                        yield handed_on(rows)
                        rows, held = [], 0
            yield handed_on(rows)

    return cut


def cut(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    memo: int | None = None,
) -> DataFrame:
    """Pieces of all documents; with their ids on request. ``memo`` bounds the words that a worker remembers."""
    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_cutter(path, length, end_id, with_ids, memo), PIECE + (", ids array<int>" if with_ids else ""))


class Bins:
    """Bins of one group, found by how much room they have."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[list[int]] = []  # per bin: piece numbers
        self.room: list[int] = []
        self._by_room: list[set[int]] = [set() for _ in range(size + 1)]
        self._rooms = 0  # bit r is set where some bin has r free places

    def _list(self, b: int) -> None:
        self._by_room[self.room[b]].add(b)
        self._rooms |= 1 << self.room[b]

    def _unlist(self, b: int) -> None:
        r = self.room[b]
        self._by_room[r].discard(b)
        if not self._by_room[r]:
            self._rooms &= ~(1 << r)

    def tightest(self, least: int, without: int = -1) -> int:
        """The fullest bin with at least ``least`` free places, or -1."""
        rooms = self._rooms >> least
        while rooms:
            r = least + (rooms & -rooms).bit_length() - 1
            b = next((b for b in self._by_room[r] if b != without), -1)
            if b >= 0:
                return b
            rooms = (self._rooms >> (r + 1)) << (r + 1 - least)
        return -1

    def underfull(self) -> list[int]:
        """Bins with room, emptiest first."""
        return [b for r in range(self.size, 0, -1) if self._rooms >> r & 1 for b in sorted(self._by_room[r]) if self.items[b]]

    def put(self, piece: int, length: int, b: int) -> None:
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.room.append(self.size)
            self._list(b)
        self._unlist(b)
        self.items[b].append(piece)
        self.room[b] -= length
        self._list(b)

    def take(self, piece: int, length: int, b: int) -> None:
        self._unlist(b)
        self.items[b].remove(piece)
        self.room[b] += length
        if self.items[b]:
            self._list(b)


def _drain(bins: Bins, lengths: list[int], a: int) -> bool:
    """Give pieces of bin ``a`` to fuller bins, as long as squared fill grows; tells whether it got empty."""
    for _ in range(ROUNDS):
        for piece in sorted(bins.items[a], key=lengths.__getitem__, reverse=True):
            b = bins.tightest(lengths[piece], a)
            if b >= 0 and bins.room[b] - lengths[piece] < bins.room[a]:
                bins.take(piece, lengths[piece], a)
                bins.put(piece, lengths[piece], b)
        if not bins.items[a]:
            return True
        swapped = [b for b in bins.underfull() if b != a and bins.room[b] <= bins.room[a] and _swap(bins, lengths, a, b)]
        if not swapped:
            return False
    return False


def _swap(bins: Bins, lengths: list[int], a: int, b: int) -> bool:
    """Give one or two pieces of ``a`` for one shorter piece of ``b``, the most that fits."""
    room = bins.room[b]
    mine = sorted((lengths[p], p) for p in bins.items[a])
    given = [(n, (p,)) for n, p in mine]
    # Two for one: of equal lengths two pieces are enough to try.
    few = [x for i, x in enumerate(mine) if i < 2 or mine[i - 2][0] != x[0]]
    given += [(m + n, (p, q)) for i, (m, p) in enumerate(few) for n, q in few[i + 1 :]]
    best = None
    sums = np.array([n for n, _ in given])
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    for length, piece in {lengths[p]: p for p in bins.items[b]}.items():
        k = int(np.searchsorted(ranked, length + room, "right")) - 1
        gain = int(ranked[k]) - length if k >= 0 else 0
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, given[order[k]][1], piece)
    if best is None:
        return False
    _, out, back = best
    for p in out:
        bins.take(p, lengths[p], a)
    bins.take(back, lengths[back], b)
    for p in out:
        bins.put(p, lengths[p], b)
    bins.put(back, lengths[back], a)
    return True


def pack_lengths(lengths: list[int], size: int = LENGTH) -> tuple[list[int], list[int]]:
    """Bin and offset of each length."""
    bins = Bins(size)
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        bins.put(piece, lengths[piece], bins.tightest(lengths[piece]))
    least = -(-sum(lengths) // size)
    left, failures = sum(map(bool, bins.items)), 0
    for a in bins.underfull():
        if left <= least or failures == PATIENCE:
            break
        if bins.items[a] and bins.room[a]:
            emptied = _drain(bins, lengths, a)
            left, failures = (left - 1, 0) if emptied else (left, failures + 1)
    place, offset = [0] * len(lengths), [0] * len(lengths)
    used = 0
    for items in bins.items:
        at = 0
        for piece in items:
            place[piece], offset[piece] = used, at
            at += lengths[piece]
        used += bool(items)
    return place, offset


def pack(parts: DataFrame, size: int = LENGTH, group: int = GROUP, again: int = AGAIN) -> DataFrame:
    """``parts`` with sequence_id and offset; needs a column ``length`` of at most ``size``.

    ``parts`` is written once with a number for each piece. Numbers and lengths alone are packed, and what they get is
    joined to the pieces. Columns named as the new ones are replaced.
    """
    spark = parts.sparkSession
    tables.ship(spark)
    parts = parts.drop("sequence_id", "offset")
    key = tables.free_name(parts, "_piece_key")
    stored = storage.checkpoint(parts.withColumn(key, F.monotonically_increasing_id()))
    open_, placed, number = stored.select(F.col(key).alias("piece_key"), F.col("length").cast("long").alias("length")), [], 0
    while True:
        groups = max(1, -(-open_.count() // group))
        # Which group a piece is in follows from its number and the round.
        dealt = open_.withColumn("group", F.pmod(F.xxhash64("piece_key", F.lit(number)), F.lit(groups)))
        rounds = storage.checkpoint(dealt.groupBy("group").applyInPandas(_packer(size, groups, number, again if groups > 1 else 0), _PLACED))
        placed.append(rounds.filter("NOT again").drop("again", "length"))
        if groups == 1:
            break
        open_, number = rounds.filter("again").select("piece_key", "length"), number + 1
    places = placed[0]
    for more in placed[1:]:
        places = places.unionByName(more)
    return stored.join(places.withColumnRenamed("piece_key", key), key).select(*parts.columns, "sequence_id", "offset")


def _packer(size: int, groups: int, number: int, again: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        place, offset = (np.array(x, np.int64) for x in pack_lengths(lengths.tolist(), size))
        room = size - np.bincount(place, lengths)
        emptiest = np.argsort(-room, kind="stable")[:again]
        return rows.assign(
            sequence_id=(place * groups + key[0]) * _MOST_ROUNDS + number, offset=offset, again=np.isin(place, emptiest[room[emptiest] > 0])
        )[["piece_key", "length", "sequence_id", "offset", "again"]]

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order; for pieces that were cut with their ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
