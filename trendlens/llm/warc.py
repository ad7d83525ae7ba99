"""WARC archives of individually compressed records with a shared dictionary.

An archive opens with a skippable Zstandard frame (magic 0x184D2A5D) that holds
a dictionary built from records of that archive; every record follows as a
frame of its own, compressed with the dictionary, so it can be read alone.
Records whose payload was archived before are ``revisit`` records.
"""
from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared_files
from .common import stored, tasks_for

DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest() -> Column:
    """SHA-1 and SHA-256 in one: different payloads with one SHA-1 have been published."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return F.concat(F.sha1(payload), F.sha2(payload, 256))


def payload_roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, first): what a payload is known by and the smallest
    page_id that has it. Groups are reduced by partial aggregation; only digests move."""
    d = pages.select("page_id", payload_digest().alias("digest"),
                     F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    first = d.groupBy("digest").agg(F.min("page_id").alias("first"))
    return d.distinct().join(first, "digest")


def record(page_id, url, html: str | None, first, min_bytes: int, date: str) -> bytes:
    payload = (html or "").encode()
    revisit = len(payload) >= min_bytes and page_id != first and first is not None
    name = lambda x: f"<urn:x-page:{'none' if x is None else x}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
            ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Refers-To", name(first)), ("WARC-Profile", PROFILE)]
    block = HTTP if revisit else HTTP + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; raw content where the samples are too few to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class ArchiveWriter:
    """Holds records until ``sample_bytes`` are there, builds the dictionary from
    them, then compresses record by record."""

    def __init__(self, stream, dictionary_size: int, sample_bytes: int, level: int):
        self.stream, self.size, self.most, self.level = stream, dictionary_size, sample_bytes, level
        self.held, self.held_bytes, self.compress = [], 0, None
        self.n, self.raw = 0, 0

    def add(self, data: bytes) -> None:
        self.n, self.raw = self.n + 1, self.raw + len(data)
        if self.compress:
            self.stream.write(self.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.most:
            self._begin()

    def _begin(self) -> None:
        import zstandard
        raw = build_dictionary([r[:1 << 16] for r in self.held], self.size)
        frame = zstandard.ZstdCompressor(level=19).compress(raw)
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
        self.compress = zstandard.ZstdCompressor(
            level=self.level, dict_data=zstandard.ZstdCompressionDict(raw)).compress
        for r in self.held:
            self.stream.write(self.compress(r))
        self.held = []

    def close(self) -> None:
        if not self.compress:
            self._begin()
        self.stream.close()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    import zstandard
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                              .stream_reader(stream, read_across_frames=True), 1 << 18)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no record start")
        head = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        block = plain.read(int(head["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("no record end")
        yield head, block


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 1 << 27, dictionary_size: int = 1 << 15,
                   sample_bytes: int = 1 << 21, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; null html is an empty
    payload, a null url has no target line) into archives of about
    ``archive_bytes`` in the shared folder; returns the stored manifest (file,
    n_records, raw_bytes). Repeated rows give repeated records; rows with a null
    page_id are revisits of a known id if there is one. Empty tables write none."""
    spark = pages.sparkSession
    folder = shared_files.new_folder(spark, "warc")
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    roles = payload_roles(p).select(F.col("page_id").alias("id"), "first", "size",
                                    F.col("digest").alias("d"))
    rows = (p.withColumn("digest", payload_digest())
            .join(roles, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
            .select("page_id", "url", "html", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri = None, ""

        def done():
            writer.close()
            return pa.RecordBatch.from_pylist([{"file": uri, "n_records": writer.n, "raw_bytes": writer.raw}])
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                if writer is None:
                    uri, stream = shared_files.create(folder, ".warc.zst")
                    writer = ArchiveWriter(stream, dictionary_size, sample_bytes, level)
                writer.add(record(*(x.as_py() for x in row), min_bytes, date))
                if writer.raw >= archive_bytes:
                    yield done()
                    writer = None
        if writer:
            yield done()

    return stored(rows.mapInArrow(run, "file string, n_records long, raw_bytes long"), "warc-list")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                   ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
                   ("payload", pa.binary())])


def _id(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives: page_id, record_type, payload_digest (bare, checked
    against each stored payload), payload_bytes, refers_to, url, payload (null for
    revisits and unless asked for)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with shared_files.open_file(file) as f:
                    for head, block in read_archive(f):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = None
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"digest mismatch in {file}")
                        n = int(head["X-Payload-Length"]) if payload is None else len(payload)
                        rows.append((_id(head["WARC-Record-ID"]), head["WARC-Type"], digest, n,
                                     _id(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"),
                                     payload if with_payload else None))
                        size += 200 + len(block) * with_payload
                        if size >= 1 << 22:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return (manifest.select("file").repartition(tasks_for(manifest.sparkSession), "file").mapInArrow(
        run, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, "
             "url string, payload binary"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
