"""Byte-pair encoding by a deterministic automaton over tokens, compiled from the merge list.

The automaton accepts exactly the token sequences that the merges produce. It starts with one state and an
arc for every byte, and takes each merge (u, v) -> w in order as a gadget: where an arc u leads to a state q
that has an arc v, u is led to a copy of q without v, and w goes from where u came to where v led. An arc's
target depends on its token alone, so a state is a chain of removed arcs, each taken away at one merge. Taking
away v also keeps from the state what later merges build with v in front; tokens are numbered along the tree
of those fronts, newest branch first, so that each removal is one interval of numbers. A state's row is its
sorted intervals, made when the state is first entered; the transition is a search in that row.

Every prefix of a word has one accepted sequence, so encoding goes over the bytes once: from each position
that was reached, follow the vocabulary's trie and take the arcs that the state has. Decoding joins the byte
labels of the arcs. Null and empty texts have no ids; special tokens are single arcs of their own. A text of any
length is one row, encoded word by word. Rows with a null id, rows that share one and repeated rows are encoded each for
itself; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import pieces, tables

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Table:
    """What the gadgets leave: one target state per token, one removal per state."""

    labels: list[bytes]  # by token id
    number: list[int]  # by token id, along the tree of fronts
    target: list[int]  # by token id; -1 for tokens that no merge makes
    parent: list[int]  # by state; -1 for the first
    low: list[int]  # by state: the numbers its last removal covers
    high: list[int]


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> Table:
    stand_ins = {c: bytes([b]) for b, c in pieces.byte_chars().items()}
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [b""] * size
    for token, i in vocab.items():
        labels[i] = b"".join(stand_ins[c] for c in token)
    for token, i in special.items():
        labels[i] = token.encode()
    rules = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
    fronts: dict[int, list[tuple[int, int]]] = {}
    for rank, (u, _, w) in enumerate(rules):
        fronts.setdefault(u, []).append((rank, w))
    number, end = [-1] * size, [0] * size
    stack = [(i, False) for i in sorted((vocab[c] for c in stand_ins if c in vocab), reverse=True)]
    count = 0
    while stack:
        token, done = stack.pop()
        if done:
            end[token] = count
            continue
        number[token], count = count, count + 1
        stack.append((token, True))
        stack += [(w, False) for _, w in fronts.get(token, ())]  # the newest is popped first

    target, parent, low, high = [-1] * size, [-1], [0], [0]
    for c in stand_ins:
        if c in vocab:
            target[vocab[c]] = 0

    def has(state: int, token: int) -> bool:
        n = number[token]
        while state > 0:
            if low[state] <= n < high[state]:
                return False
            state = parent[state]
        return True

    for rank, (u, v, w) in enumerate(rules):
        q = target[u]
        if not has(q, v):
            continue
        older = next((x for r, x in reversed(fronts.get(v, [])) if r < rank), None)
        target[w] = target[v]
        parent.append(q)
        low.append(number[v])
        high.append(end[v] if older is None else number[older])
        target[u] = len(parent) - 1
    return Table(labels, number, target, parent, low, high)


class Automaton:
    """Table-driven encoding and decoding; rows of states are made as they are entered."""

    def __init__(self, table: Table):
        self._table = table
        self._rows: dict[int, tuple[list[int], list[int]]] = {}
        trie: list[dict[int, int]] = [{}]
        leaf = [-1]
        for token, label in enumerate(table.labels):
            if table.target[token] < 0:
                continue
            node = 0
            for byte in label:
                if byte not in trie[node]:
                    trie[node][byte] = len(trie)
                    trie.append({})
                    leaf.append(-1)
                node = trie[node][byte]
            leaf[node] = token
        self._trie, self._leaf = trie, leaf

    def _row(self, state: int) -> tuple[list[int], list[int]]:
        row = self._rows.get(state)
        if row is None:
            table, spans, at = self._table, [], state
            while at > 0:
                spans.append((table.low[at], table.high[at]))
                at = table.parent[at]
            lows: list[int] = []
            highs: list[int] = []
            for low, high in sorted(spans):
                if lows and low <= highs[-1]:
                    highs[-1] = max(highs[-1], high)
                else:
                    lows.append(low)
                    highs.append(high)
            row = self._rows[state] = (lows, highs)
        return row

    def encode(self, word: bytes) -> list[int]:
        size, trie, leaf = len(word), self._trie, self._leaf
        number, target = self._table.number, self._table.target
        state, arc, came = [-1] * (size + 1), [-1] * (size + 1), [0] * (size + 1)
        state[0] = 0
        for i in range(size):
            lows, highs = self._row(state[i])
            node = 0
            for j in range(i, size):
                node = trie[node].get(word[j], -1)
                if node < 0:
                    break
                token = leaf[node]
                if token < 0 or state[j + 1] >= 0:
                    continue
                n = number[token]
                k = bisect_right(lows, n) - 1
                if k < 0 or n >= highs[k]:
                    state[j + 1], arc[j + 1], came[j + 1] = target[token], token, i
        out, at = [], size
        while at:
            out.append(arc[at])
            at = came[at]
        return out[::-1]

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._table.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Automaton, pieces.TextEncoder]:
    """Compiled from the vocabulary file, once per Python worker."""
    shape = pieces.settings(path)
    special = pieces.special_tokens(shape)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in shape["model"]["merges"]]
    automaton = Automaton(compile_merges(shape["model"]["vocab"], merges, special))

    def encode_word(word: str) -> bytes:
        return np.array(automaton.encode(word.encode()), pieces.ID).tobytes()

    return automaton, pieces.TextEncoder(encode_word, special)


def _mapper(path: str, row, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, encoder = load(path)
        for batch in batches:
            rows = [row(doc_id, x.as_py(), automaton, encoder) for doc_id, x in zip(batch.column(0), batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids of its whole text."""

    def row(doc_id, text, automaton, encoder):
        return doc_id.as_py(), np.frombuffer(encoder.ids(text), pieces.ID)

    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    mapper = _mapper(path, row, ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())])
    return rows.mapInArrow(mapper, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def row(doc_id, ids, automaton, encoder):
        return doc_id.as_py(), automaton.decode(ids or ())

    tables.ship(tokens.sparkSession)
    mapper = _mapper(path, row, ["doc_id", "text"], [pa.int64(), pa.string()])
    return tokens.select("doc_id", "ids").mapInArrow(mapper, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the text they decode to."""

    def row(doc_id, text, automaton, encoder):
        ids = encoder.ids(text)
        decoded = automaton.decode(np.frombuffer(ids, pieces.ID).tolist())
        sums = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        return doc_id.as_py(), len(ids) // pieces.ID.itemsize, *sums

    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    mapper = _mapper(path, row, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])
    return rows.mapInArrow(mapper, DIGEST)
