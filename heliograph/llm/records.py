"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is framed as in the TFRecord layout: payload length (unsigned 64 bits), masked CRC-32C of those
eight bytes, payload, masked CRC-32C of the payload, all little-endian. The payload holds flags, the document
id and the ids in 16 bits, or 32 where an id needs them. The index has 16 bytes per record (offset, payload
length), so record k of a file is found by one seek, in any order.

Files are in ascending id order across and within: documents are dealt out by range of their id, and each
task writes one file. A task that is run again writes a file of its own; only files named in the manifest,
which Spark commits, belong to the set. Null texts are empty (a record with just the end id); rows with a null
id come first; rows that share an id are neighbours in any order. A long text is one record, checked block by block. Other
columns are ignored. An empty table gives an empty set.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import pieces, tables
from heliograph.llm.byte_bpe import grouped

_LENGTH = struct.Struct("<Q")
_CRC = struct.Struct("<I")
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
_HEAD = struct.Struct("<Bq")
_WIDE, _NO_ID = 1, 2
_FRAME = _LENGTH.size + 2 * _CRC.size
_READ = 8 << 20
_CHARS = 1 << 20  # of texts whose records are framed together
_ROWS = 4096

MANIFEST = "part int, file string, n_records long, n_tokens long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"

# Fixed values of CRC-32C (reflected Castagnoli polynomial) and of the mask.
_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8
_BLOCK = 4096


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per distance from a block's end, what each byte value adds to the checksum; and row starts."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    rows = np.empty((_BLOCK, 256), np.uint32)
    rows[-1] = table
    for i in range(_BLOCK - 2, -1, -1):
        rows[i] = (rows[i + 1] >> 8) ^ table[rows[i + 1] & 0xFF]
    return rows.ravel(), np.arange(_BLOCK, dtype=np.int64) * 256


def crc32c(data: bytes) -> int:
    """A checksum is linear in its bytes, so a block is one table lookup per byte and one XOR over all."""
    rows, starts = _crc_tables()
    values = np.frombuffer(data, np.uint8)
    state = 0xFFFFFFFF
    for at in range(0, len(values), _BLOCK):
        block = values[at : at + _BLOCK].copy()
        if len(block) < _CRC.size:
            for byte in block.tolist():
                state = (state >> 8) ^ int(rows[-256 + ((state ^ byte) & 0xFF)])
        else:
            block[: _CRC.size] ^= np.frombuffer(_CRC.pack(state), np.uint8)
            state = int(np.bitwise_xor.reduce(rows[starts[_BLOCK - len(block) :] + block]))
    return state ^ 0xFFFFFFFF


def masked(checksum):
    """Of one checksum, or an array of them."""
    if isinstance(checksum, np.ndarray):
        return ((checksum >> 15) | (checksum << 17)) + np.uint32(_MASK_DELTA)
    return (((checksum >> 15) | (checksum << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Masked checksums of ascending parts of ``data`` that do not overlap.

    What each byte adds follows from its distance to the end of its part, so all parts of at most a block are looked up
    together and folded part by part. Longer and very short ones go by :func:`crc32c`.
    """
    rows, _ = _crc_tables()
    sums = np.empty(len(begins), np.uint32)
    sizes = ends - begins
    together = (sizes >= _CRC.size) & (sizes <= _BLOCK)
    for i in np.flatnonzero(~together).tolist():
        sums[i] = crc32c(data[begins[i] : ends[i]].tobytes())
    first, size = begins[together], sizes[together]
    if len(first):
        folds = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int32)
        values = data[at + np.repeat((first - folds).astype(np.int32), size)]
        values[(folds[:, None] + np.arange(_CRC.size)).ravel()] ^= 0xFF  # the state that a checksum begins with
        places = (at + np.repeat((_BLOCK - size - folds).astype(np.int32), size)) << 8 | values
        sums[together] = np.bitwise_xor.reduceat(rows.take(places), folds) ^ np.uint32(0xFFFFFFFF)
    return masked(sums)


def frame_all(payloads: list[bytes]) -> tuple[bytearray, np.ndarray]:
    """The framed records one after the other, and their index entries counted from the first."""
    sizes = np.array(list(map(len, payloads)), np.int64)
    begins = np.cumsum(sizes + _FRAME) - sizes - _FRAME
    blank = bytes(_CRC.size)
    data = bytearray(b"".join(part for p in payloads for part in (_LENGTH.pack(len(p)), blank, p, blank)))
    view = np.frombuffer(data, np.uint8)
    for part in (np.stack([begins, begins + _LENGTH.size], 1), np.stack([begins + _LENGTH.size + _CRC.size, begins + _FRAME - _CRC.size + sizes], 1)):
        sums = checksums(view, part[:, 0], part[:, 1]).astype("<u4").view(np.uint8).reshape(-1, _CRC.size)
        view[part[:, 1, None] + np.arange(_CRC.size)] = sums
    index = np.empty(len(payloads), _INDEX)
    index["offset"], index["length"] = begins, sizes
    return data, index


def unframe_all(data: bytes, entries: np.ndarray) -> list[bytes]:
    """The payloads of framed records that follow each other; raises where a length or checksum does not hold."""
    view, sizes = np.frombuffer(data, np.uint8), entries["length"].astype(np.int64)
    begins = entries["offset"].astype(np.int64) - int(entries["offset"][0])
    bodies = begins + _LENGTH.size + _CRC.size
    ends = bodies + sizes
    lengths = view[begins[:, None] + np.arange(_LENGTH.size)].view("<u8").ravel()
    fits = len(data) == ends[-1] + _CRC.size and (lengths == sizes).all()
    for start, end in ((begins, begins + _LENGTH.size), (bodies, ends)) if fits else ():
        stored = view[end[:, None] + np.arange(_CRC.size)].view("<u4").ravel()
        fits = fits and (stored == checksums(view, start, end)).all()
    if not fits:
        raise ValueError("damaged record")
    return [data[a:b] for a, b in zip(bodies.tolist(), ends.tolist())]


def payload(doc_id: int | None, ids: bytes) -> bytes:
    values = np.frombuffer(ids, pieces.ID)
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    flags = _WIDE * wide + _NO_ID * (doc_id is None)
    return _HEAD.pack(flags, doc_id or 0) + (ids if wide else values.astype("<u2").tobytes())


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of a payload."""
    flags, doc_id = _HEAD.unpack_from(data)
    ids = np.frombuffer(data, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size)
    return (None if flags & _NO_ID else doc_id), ids.astype(pieces.ID)


def frame(data: bytes) -> bytes:
    return bytes(frame_all([data])[0])


def unframe(framed: bytes) -> bytes:
    """The payload of one framed record; raises where a length or checksum does not hold."""
    return unframe_all(framed, np.array([(0, max(len(framed) - _FRAME, 0))], _INDEX))[0]


class RecordFile:
    """Random access to one file by its index."""

    def __init__(self, path: str):
        files, place = tables.shared_files(path)
        self._data = files.open_input_file(place)
        self._index = files.open_input_file(f"{place}.index")
        self._count = self._index.size() // _INDEX.itemsize

    def __len__(self) -> int:
        return self._count

    def _entries(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self._index.read_at(count * _INDEX.itemsize, first * _INDEX.itemsize), _INDEX)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        if not 0 <= k < self._count:
            raise IndexError(k)
        entry = self._entries(k, 1)
        data = self._data.read_at(int(entry["length"][0]) + _FRAME, int(entry["offset"][0]))
        return parse(unframe_all(data, entry)[0])

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """In file order, by large reads."""
        for first in range(0, self._count, _ROWS):
            entries = self._entries(first, min(_ROWS, self._count - first))
            begin, ends = int(entries["offset"][0]), (entries["offset"] + entries["length"] + _FRAME).astype(int)
            at = 0
            while at < len(entries):
                stop = max(at + 1, int(np.searchsorted(ends, begin + _READ, "right")))
                block = self._data.read_at(int(ends[stop - 1]) - begin, begin)
                yield from map(parse, unframe_all(block, entries[at:stop]))
                at, begin = stop, int(ends[stop - 1])

    def close(self) -> None:
        self._data.close()
        self._index.close()


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = pieces.library_encoder(path)
        end = np.array([end_id], pieces.ID).tobytes()
        part = TaskContext.get().partitionId()
        files, place = tables.shared_files(folder)
        files.create_dir(place, recursive=True)
        name = f"part-{part:08d}-{uuid.uuid4().hex}.records"
        records = tokens = offset = 0
        with files.open_output_stream(f"{place}/{name}") as data, files.open_output_stream(f"{place}/{name}.index") as index:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for first, last in grouped([len(t or "") for t in texts], _CHARS):
                    packed = [encoder.ids(text) + end for text in texts[first:last]]
                    framed, entries = frame_all(list(map(payload, doc_ids[first:last], packed)))
                    entries["offset"] += np.uint64(offset)
                    data.write(framed)
                    index.write(entries.tobytes())
                    records, offset = records + len(packed), offset + len(framed)
                    tokens += sum(map(len, packed)) // pieces.ID.itemsize
        if records:
            row = {"part": [part], "file": [f"{folder}/{name}"], "n_records": [records], "n_tokens": [tokens]}
            types = {"part": pa.int32(), "file": pa.string(), "n_records": pa.int64(), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(row[c], t) for c, t in types.items()], names=list(types))

    return write


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the documents' ids under ``folder``; returns the manifest of its files in order.

    The text is dealt out, not the ids: the range bounds are sampled before anything is encoded.
    """
    tables.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(_writer(f"{folder}/data", path, end_id), MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            records, out = RecordFile(file), []
            for doc_id, ids in records:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(out) == _ROWS:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
            records.close()


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens and the CRC-32 of its ids.

    Only the manifest, one row per file, is summed up in one place.
    """
    tables.ship(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(1, manifest.count())
    return starts.select("file", "start").repartition(parts).mapInArrow(_reader, RECORD)
