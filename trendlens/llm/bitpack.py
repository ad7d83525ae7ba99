"""Token ids in files of fixed-width packed integers.

File: ids of consecutive documents, each id in the fewest bits that hold the
vocabulary, little-endian bit order, in blocks of ``BLOCK`` ids that start on a
byte; then the document table (id, null flag, number of ids), the byte offset of
every block, and a tail with the counts. A reader seeks to any block, or to any
range of ids, and unpacks it with NumPy alone.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared_files
from .common import stored, tasks_for

MAGIC = b"TIDPACK1"
BLOCK = 1 << 16
TAIL = struct.Struct("<8sIIQQQQ")
FILE_IDS = 1 << 24
# what the tokenizer's pattern takes as blank (White_Space; re's own class has four more)
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_BLANKS = f"[{BLANKS[4:]}]"
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([32 < b < 128 for b in range(256)]) & ~_LETTER


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, np.uint8, count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    return planes.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class PackWriter:
    """Writes one file; memory is one block and the document table."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.at, self.n, self.held = 0, 0, []
        self.room = BLOCK
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.n += len(ids)
        while len(ids):
            part, ids = ids[:self.room], ids[self.room:]
            self.held.append(part)
            self.room -= len(part)
            if not self.room:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            self.offsets.append(self.at)
            data = pack(np.concatenate(self.held), self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.held, self.room = [], BLOCK

    def close(self) -> None:
        self._flush()
        table = np.array([d[0] for d in self.docs], "<i8").tobytes() + np.array(
            [d[1] for d in self.docs], np.uint8).tobytes() + np.array([d[2] for d in self.docs], "<i8").tobytes()
        self.stream.write(table)
        self.stream.write(np.array(self.offsets, "<i8").tobytes())
        self.stream.write(TAIL.pack(MAGIC, self.bits, BLOCK, self.n, len(self.docs), len(self.offsets), self.at))
        self.stream.close()


class PackReader:
    """Reads a file of ``PackWriter``: its documents, and any range of ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, self.bits, self.block, self.n, n_docs, n_blocks, at = TAIL.unpack(
            file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        table = file.read_at(n_docs * 17 + n_blocks * 8, at)
        ids = np.frombuffer(table, "<i8", n_docs)
        null = np.frombuffer(table, np.uint8, n_docs, n_docs * 8)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.lengths = np.frombuffer(table, "<i8", n_docs, n_docs * 9)
        self.offsets = np.append(np.frombuffer(table, "<i8", n_blocks, n_docs * 17), at)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file; reads only the blocks they lie in."""
        first, last = start // self.block, -(-end // self.block)
        if end <= start:
            return np.zeros(0, np.uint32)
        raw = self.file.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for b in range(first, last):
            data = raw[self.offsets[b] - self.offsets[first]:self.offsets[b + 1] - self.offsets[first]]
            out.append(unpack(data, self.bits, min(self.block, self.n - b * self.block)))
        return np.concatenate(out)[start - first * self.block:end - first * self.block]

    def documents(self, buffer: int = 1 << 21) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in file order, about ``buffer`` ids in memory."""
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        held, at = np.zeros(0, np.uint32), 0
        for d, s, e in zip(self.doc_ids, starts[:-1], starts[1:]):
            if e > at + len(held):
                held, at = self.ids(s, min(self.n, max(e, s + buffer))), s
            yield d, int(s), held[s - at:e - at]


def pieces(texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What ``TokenEncoder.pattern`` finds in texts without ``ODD_BLANKS``, cut once more
    behind ASCII letters, and how many pieces end with each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    blank = (data == 32) | (data > 8) & (data < 14)
    after = np.append(~blank[1:], False)                       # a byte that is not blank follows in the text
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    begin = blank & after
    begin[1:] |= blank[1:] & ~blank[:-1] | ~blank[1:] & blank[:-1] & (data[:-1] != 32)
    begin[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]          # a run of letters ends before a sign or digit
    begin[offsets[:-1][offsets[:-1] < size]] = True
    at = np.flatnonzero(begin)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, size)), pa.py_buffer(data))
    return found.dictionary_encode(), np.searchsorted(at, offsets[1:])


def joined(ids: list[bytes], indices: pa.Array, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each text, from those of its pieces."""
    if not len(indices):
        yield from (np.zeros(0, np.uint32) for _ in ends)
        return
    taken = pa.array(ids, pa.large_binary()).take(indices)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1] // 4
    flat, start = np.frombuffer(taken.buffers()[2], np.uint32), 0
    for end in offsets[ends].tolist():
        yield flat[start:end]
        start = end


class TokenEncoder:
    """The tokenizers library over whole texts; pieces seen before are looked up. A piece
    is a run without blanks with the one space before it, or a part of a run of blanks:
    one or more whole pretokens, as none reaches over a blank but its own first space (and
    the byte-level pattern splits before any merge, so ids are the same). Two
    generations of ``memory`` pieces are kept: one that is met again moves to the
    younger, and a full younger one takes the place of the older."""

    def __init__(self, tokenizer_file: str, memory: int = 500_000):
        import os

        import regex
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory, self.young, self.old = memory, {}, {}
        self.opens = np.zeros(self.vocabulary, bool)          # tokens that begin with a blank
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("\u0120")
        whole = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.pattern = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
        # what the patterns stand for must be the file's own splitting
        probe = "it's a  b\n\n c1,2 ..x\t"
        if [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] != [
                self.tokenizer.pre_tokenizer.pre_tokenize_str(w)[0][0] for w in whole.findall(probe)] \
                or self.tokenizer.normalizer is not None:
            self.pattern = None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.pattern is None:
            return self._whole(texts)
        column = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)                    # texts that hold added tokens
        for token in self.added:
            whole |= np.asarray(pc.match_substring(column, token))
        odd = ~whole & np.asarray(pc.match_substring_regex(column, ODD_BLANKS))
        words = {int(k): self.pattern.findall(texts[k]) for k in np.flatnonzero(odd)}
        plain = np.flatnonzero(~whole & ~odd)
        coded, ends = pieces(column.take(pa.array(plain)))
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()    # to_pylist makes a scalar of each
        young = self.young
        missing = set(own).union(*words.values()).difference(young)
        again = {w: self.old[w] for w in missing & self.old.keys()}
        fresh = list(missing.difference(again))
        young.update(again)
        young.update(zip(fresh, self._pretokens(fresh)))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k, ids in zip(plain, joined([young[w] for w in own], coded.indices, ends)):
            out[k] = ids
        for k, ws in words.items():
            out[k] = np.frombuffer(b"".join(map(young.__getitem__, ws)), np.uint32)
        for k in np.flatnonzero(whole):
            out[k] = self._whole([texts[k]])[0]
        for w in fresh:
            if len(w) > 64:
                del young[w]
        if len(young) > self.memory:
            self.old, self.young = young, {}
        return out

    def _pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of single pieces. Those that begin with one blank are encoded in one text:
        it splits before every blank again, and only a first token begins with one."""
        apart = [k for k, w in enumerate(words) if w[0] != " " or len(w) < 2 or w[1].isspace()]
        joined = sorted(set(range(len(words))).difference(apart))
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(joined), 1 << 14):
            own = joined[at:at + (1 << 14)]
            ids = self._whole(["".join(words[k] for k in own)])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(own):
                apart += own
                continue
            data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            for k, s, e in zip(own, (4 * starts).tolist(), ends):
                out[k] = data[s:e]
        for k, ids in zip(apart, self._whole([words[k] for k in apart])):
            out[k] = ids.tobytes()
        return out


_ENCODERS: dict[str, TokenEncoder] = {}


def encoder_of(tokenizer_file: str) -> TokenEncoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = TokenEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, name: str = "tokens") -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, and write packed
    files in ascending doc_id order (nulls first, equal ids by text). Returns the
    stored manifest (file, n_docs, n_ids, start): ``start`` counts the ids of all
    files before. Empty tables write no file; other columns are not read."""
    spark = docs.sparkSession
    folder = shared_files.new_folder(spark, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(tokenizer_file)
        bits = bits_for(max(e.vocabulary, end_id + 1))
        end = np.array([end_id], np.uint32)
        part, seq, writer, uri = TaskContext.get().partitionId(), 0, None, ""

        def done():
            writer.close()
            return pa.RecordBatch.from_pylist([{"file": uri, "part": part, "seq": seq,
                                                "n_docs": len(writer.docs), "n_ids": writer.n}])
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for a in range(0, len(doc_ids), 512):
                for d, ids in zip(doc_ids[a:a + 512], e.encode([t or "" for t in texts[a:a + 512].to_pylist()])):
                    if writer is None:
                        uri, stream = shared_files.create(folder, ".ids")
                        writer = PackWriter(stream, bits)
                    writer.add(d, np.concatenate([ids, end]))
                    if writer.n >= FILE_IDS:
                        yield done()
                        writer, seq = None, seq + 1
        if writer:
            yield done()

    ordered = (docs.select(F.col("doc_id").cast("long"), "text")
               .repartitionByRange(tasks_for(spark), F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    manifest = stored(ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long"), name + "-list")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return stored(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
                  .drop("part", "seq"), name + "-list")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary): the documents of the files; ids as little-endian
    unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                with shared_files.open_file(row["file"]) as f:
                    for d, s, ids in PackReader(f).documents():
                        rows.append({"doc_id": d, "start": row["start"] + s, "ids": ids.astype("<u4").tobytes()})
                        size += len(ids)
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return (manifest.select("file", "start").repartition(tasks_for(manifest.sparkSession), "file")
            .mapInArrow(run, "doc_id long, start long, ids binary"))


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_token_files``."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
