"""Fill-in-the-middle: documents cut at two unit ranks and put in another order, found by an indexable skip list.

The units of a text are its lines. They stand in a skip list whose links carry two widths, in units and in code
points: lane 0 links each unit to the next, and every lane above keeps about a quarter of the one below, its links
as wide as what they pass. Going down from the highest lane, as far right as the wanted rank allows on each, adds up
to the code point at which that unit begins, so both cuts are met exactly in a number of steps that grows with the
logarithm of the units. Which units rise is decided by a fixed mixing of their place, so a rerun cuts alike.

Where and whether a document is changed follows from a hash of its id. Texts that hold one of the marks, and empty
ones, stay plain, so every other output has each mark once and can be taken apart again.

A null text is empty. Rows that share an id are cut at the same ranks of their own texts; a null id counts as the
empty string in the hash. Other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm import tables

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100  # percent of the documents that are changed
SPM_RATE = 50  # percent of those that have the suffix first
CHANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_MIX = np.uint64(0x9E3779B97F4A7C15)


class SkipList:
    """Units of given widths by their rank."""

    def __init__(self, widths: list[int]):
        chars = np.array(widths, np.int64)
        units = np.ones(len(chars), np.int64)
        self.size = len(chars)
        # Per lane, of every node (the first is the head): units and code points to the next, and its place below.
        self._units, self._chars, self._below = [units.tolist()], [widths], [[]]
        while len(units) > 4:
            places = np.arange(len(units), dtype=np.uint64) + np.uint64(len(self._units))
            rises = (places * _MIX) >> np.uint64(62) == 0
            rises[0] = True  # the head is on every lane
            kept = np.flatnonzero(rises)
            if len(kept) == len(units):
                break
            units, chars = np.add.reduceat(units, kept), np.add.reduceat(chars, kept)
            self._units.append(units.tolist())
            self._chars.append(chars.tolist())
            self._below.append(kept.tolist())

    def seek(self, rank: int) -> tuple[int, int]:
        """Code points before the unit of this rank, counted from 0, and the links that were passed."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = passed = offset = steps = 0
        for lane in range(len(self._units) - 1, -1, -1):
            units, chars = self._units[lane], self._chars[lane]
            while node < len(units) and passed + units[node] <= rank:
                passed, offset, node, steps = passed + units[node], offset + chars[node], node + 1, steps + 1
            if passed == rank:
                break
            node = self._below[lane][node] if lane else node
        return offset, steps


def line_widths(text: str) -> list[int]:
    """Code points of each line, its end included."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def coins(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def change(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple:
    """Lines, form, code points of prefix and middle, and the text in its new order."""
    units = SkipList(line_widths(text))
    first, second, whether, which = coins(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or whether % 100 >= rate:
        return units.size, "plain", None, None, text
    low, high = sorted((first % (units.size + 1), second % (units.size + 1)))
    a, b = units.seek(low)[0], units.seek(high)[0]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < spm_rate:
        return units.size, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.size, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(
    docs: DataFrame,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document its lines, form, code points of prefix and middle (null where plain) and output text."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *change(i, t or "", rate, spm_rate, seed)) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, CHANGED)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the marks are in it once each, and none can arise across a seam."""
    parts = F.split(output, "|".join(MARKS), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
