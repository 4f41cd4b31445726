"""Web archives with a two-level capture index.

Each task writes one WARC file, a gzip member per record. Payloads that are equal (by SHA-1, from a least size
on) are stored once: the record with the smallest id is a response, the others are revisits that name it.

The index sorts captures by reversed-host URL key and id. Each part of it is a file of compressed blocks of
lines and a sparse directory with the first key of each block; one small table names the parts and their first
keys. A lookup searches the parts, then the part's directory, then the one block by bisection, and reads one
range of one archive. Lookups are dealt out in key order, so a task meets each block once.

A null payload is empty, a null URL has the empty key. Each row gets a record of its own, also rows that repeat
an id or a URL; revisits never name a null id. One payload may be that of most rows: the table of first
holders is written before it is joined, so that Spark can split the common digest or broadcast by size.
A payload of any length is one record; other columns are ignored. An empty table gives empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import tables
from heliograph.sources import storage

BLOCK = 1000  # lines of an index block
DATE = "1970-01-01T00:00:00Z"  # the capture time of tables that have none
_BATCH = 512
_TASK_RECORDS, _TASK_BYTES = 8192, 32 << 20  # what a task of the index or of a lookup covers
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_PART = "first_key string, file string, n_blocks long, n_lines long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``com,example,m)/path?q``. Port, user, ``www.`` and fragment go."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^www\.", "")
    path = F.regexp_extract(url, parts, 2)
    hosted = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    key = F.when(host == "", F.regexp_replace(url, "#.*", "")).otherwise(hosted)
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20]", "_"), F.lit(""))


def _sort_key(key: Column, page_id: Column) -> Column:
    """Key and id in one string, which orders and names a capture."""
    return F.concat(key, F.lit(" "), F.coalesce(F.lpad(F.hex(page_id), 16, "0"), F.lit("-")))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, key, payload, digest and refers_to, which is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest")
    )
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    holders = storage.checkpoint(large.groupBy("digest").agg(F.min("page_id").alias("holder"))).filter("holder IS NOT NULL")
    joined = rows.join(holders, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("holder"), F.col("holder").isNotNull())
    return joined.select(
        "page_id", "url", _sort_key(url_key(F.col("url")), F.col("page_id")).alias("key"), "payload", "digest",
        F.when(revisit, F.col("holder")).alias("refers_to"),
    )


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit keeps the response's HTTP head, which tells its length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _name(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload's digest is taken anew where the payload is there."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    stored = fields["WARC-Type"] == "response"
    if stored and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload": payload if stored else None,
    }


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _archive_writer(folder: str):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        out, offset, name, place = None, 0, f"{uuid.uuid4().hex}.warc.gz", ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files, place = tables.shared_files(folder)
                    files.create_dir(place, recursive=True)
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                member = gzip.compress(data, 6, mtime=0)
                out.write(member)
                yield row["key"], row["page_id"], f"{folder}/{name}", offset, len(member)
                offset += len(member)
        if out is not None:
            out.close()

    return lambda batches: _batches(rows(batches), schema)


def _index_writer(folder: str):
    schema = pa.schema([("first_key", pa.string()), ("file", pa.string()), ("n_blocks", pa.int64()), ("n_lines", pa.int64())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                yield key, f"{key}\t{offset}\t{length}\t{file}\n"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        out, directory, block, first, offset, n_lines, name = None, [], [], None, 0, 0, uuid.uuid4().hex

        def close_block():
            nonlocal offset, block
            member = gzip.compress("".join(x for _, x in block).encode(), 6, mtime=0)
            out.write(member)
            directory.append(f"{block[0][0]}\t{offset}\t{len(member)}\n")
            offset, block = offset + len(member), []

        for key, line in lines(batches):
            if out is None:
                files, place = tables.shared_files(folder)
                files.create_dir(place, recursive=True)
                out, first = files.open_output_stream(f"{place}/{name}.blocks", compression=None), key
            block.append((key, line))
            n_lines += 1
            if len(block) == BLOCK:
                close_block()
        if out is None:
            return
        if block:
            close_block()
        out.close()
        with files.open_output_stream(f"{place}/{name}.directory", compression=None) as sparse:
            sparse.write("".join(directory).encode())
        yield first, f"{folder}/{name}", len(directory), n_lines

    return lambda batches: _batches(rows(batches), schema)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Archives and index of ``pages`` (page_id, url, html) under ``folder``.

    Only files that Spark's committed tables name belong to the archive, so a task that is run again harms nothing.
    """
    tables.ship(pages.sparkSession)
    spark = pages.sparkSession
    kept = captures(pages, least_bytes)
    kept.mapInArrow(_archive_writer(f"{folder}/archive"), _CAPTURE).write.parquet(f"{folder}/captures")
    found = spark.read.schema(_CAPTURE).parquet(f"{folder}/captures")
    ordered = found.repartitionByRange(_tasks(found), "key").sortWithinPartitions("key")
    ordered.mapInArrow(_index_writer(f"{folder}/index"), _PART).write.parquet(f"{folder}/parts")


def _tasks(captures: DataFrame) -> int:
    """Tasks by what they read from the archive: keys alone look small, and would be joined into few."""
    records, size = captures.agg(F.count("*"), F.sum("length")).first()
    return max(1, -(-records // _TASK_RECORDS), -(-(size or 0) // _TASK_BYTES))


class Index:
    """Reads an index from inside a task; holds the parts' first keys and the last few files it touched."""

    def __init__(self, folder: str):
        files, place = tables.shared_files(folder)
        parts = pq.read_table(f"{place}/parts", filesystem=files, columns=["first_key", "file"]).to_pylist()
        parts.sort(key=lambda p: p["first_key"])
        self._parts = [p["file"] for p in parts]
        self._first = [p["first_key"] for p in parts]
        self._directory = lru_cache(4)(self._read_directory)
        self._block = lru_cache(4)(self._read_block)
        self._open = lru_cache(32)(self._open_file)

    @staticmethod
    def _open_file(path: str):
        files, place = tables.shared_files(path)
        return files.open_input_file(place)

    def _range(self, path: str, offset: int, length: int) -> bytes:
        return self._open(path).read_at(length, offset)

    def _read_directory(self, part: str) -> tuple[list[str], list[tuple[int, int]]]:
        file = self._open_file(f"{part}.directory")
        rows = [line.split("\t") for line in file.read().decode().split("\n")[:-1]]
        file.close()
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _read_block(self, part: str, number: int) -> tuple[list[str], list[list[str]]]:
        offset, length = self._directory(part)[1][number]
        lines = zlib.decompress(self._range(f"{part}.blocks", offset, length), 31).decode().split("\n")[:-1]
        rows = [line.split("\t") for line in lines]
        return [r[0] for r in rows], rows

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture with the key; copies may reach over blocks and parts."""
        for p in range(max(0, bisect_left(self._first, key) - 1), bisect_right(self._first, key)):
            part = self._parts[p]
            firsts = self._directory(part)[0]
            for number in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                keys, rows = self._block(part, number)
                for row in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield row[3], int(row[1]), int(row[2])

    def read(self, file: str, offset: int, length: int) -> dict:
        return parse(zlib.decompress(self._range(file, offset, length), 31))


def _looker(folder: str, with_payload: bool):
    types = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    types += [("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(types)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        index, last = None, None
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if key == last:
                    continue
                index, last = index or Index(folder), key
                for place in index.find(key):
                    found = index.read(*place)
                    yield tuple(found[name] for name in schema.names)

    return lambda batches: _batches(rows(batches), schema)


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the captures that ``wanted`` (page_id, url) names, each once."""
    tables.ship(spark)
    keys = wanted.select(_sort_key(url_key(F.col("url")), F.col("page_id").cast("long")).alias("key"))
    dealt = keys.repartitionByRange(_tasks(spark.read.schema(_CAPTURE).parquet(f"{folder}/captures")), "key").sortWithinPartitions("key")
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    return dealt.mapInArrow(_looker(folder, with_payload), schema)
