"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one task. Its words are numbered by the
benchmark's vocabulary; a word the benchmark lacks ends a string of the shard's
text, since no phrase can contain it, and strings shorter than the shortest
phrase cannot hold one. Over these strings the shard builds a suffix array,
the Burrows-Wheeler transform in a wavelet matrix, and samples of suffix
positions. Every phrase is searched backwards through wavelet ranks, all phrases
at once; occurrences are located by walking to a sampled position, and the
covered words are merged into removal spans.

The documents are read once and never move. The benchmark is broadcast in
blocks of a set size, and a larger benchmark takes more passes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")          # on bytes after lower-casing A-Z
SHARD_WORDS = 1 << 21
SAMPLE = 8
BLOCK_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.total = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access over a sequence of small integers, for arrays of arguments."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = ((seq >> shift) & 1).astype(bool)
            seq = np.concatenate([seq[~bits], seq[bits]])
            self.levels.append((shift, Bits(bits), len(seq) - int(bits.sum())))
        self.first = np.zeros(alphabet, np.int64)
        symbols = np.arange(alphabet)
        self.first = self.rank(symbols, np.zeros(alphabet, np.int64))     # where each symbol's run starts

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it occurs before i."""
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c |= one << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; zeros end strings and are ordered by their
    position, so no comparison passes one. Only unsettled suffixes are sorted on."""
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    key = text.astype(np.int64) + n_ends - 1
    key[ends] = np.arange(n_ends)
    sa = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[sa], prepend=-1))
    size = np.diff(start, append=n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(start, size)
    active = sa[np.repeat(size > 1, size)]
    k = 1
    while len(active):
        key = rank[active] * n + rank[active + k]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        group = np.flatnonzero(np.diff(old, prepend=-1))
        offset = np.arange(len(active)) - np.repeat(group, np.diff(group, append=len(active)))
        sa[old + offset] = active
        first = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(first, append=len(active))
        rank[active] = np.repeat(old[first] + offset[first], size)
        active = active[np.repeat(size > 1, size)]
        k *= 2
    return sa


class FMIndex:
    """Search index of strings of positive integers, each followed by a zero."""

    def __init__(self, text: np.ndarray, alphabet: int, offset_in_string: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.n = len(text)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.bwt = WaveletMatrix(text[sa - 1].astype(np.int64), alphabet)
        marked = offset_in_string[sa] % sample == 0        # the first position of a string is one
        self.marked, self.samples = Bits(marked), sa[marked]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that start with each row of ``phrases``."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1].astype(np.int64):
            alive = lo < hi
            if not alive.any():
                break
            base = self.counts[c]
            lo = np.where(alive, base + self.bwt.rank(c, lo), 0)
            hi = np.where(alive, base + self.bwt.rank(c, hi), 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            out[todo[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            c, r = self.bwt.access(at)
            at, steps = self.counts[c] + r, steps + 1
        return out


class Phrases:
    """Windows of a block of benchmark items, numbered by the items' vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i:i + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(w) for w in found}):
            own = sorted(w for w in found if len(w) == n)
            self.by_length[n] = np.array(own, np.int64), [sorted(found[w]) for w in own]
        self.shortest = min(self.by_length, default=0)
        self._number = _Numbers(self.vocabulary)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, 0 for words that no item has: four bytes a word are held."""
        return np.fromiter(map(self._number.__getitem__, words), np.int32, len(words))


class _Numbers(dict):
    def __missing__(self, word):
        return 0


def search_shard(words: list[list[bytes]], phrases: Phrases) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Per document: the ids of the items found, and merged word spans [start, end)."""
    return search_numbers([phrases.numbers(w) for w in words], phrases)


def search_numbers(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """``search_shard`` of documents as arrays of their words' numbers."""
    empty: list[tuple[list[str], list[tuple[int, int]]]] = [([], []) for _ in docs]
    if not phrases.by_length:
        return empty
    lengths = np.array([len(w) + 1 for w in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    gap = np.zeros(1, np.int32)                            # a zero between documents
    ids = np.concatenate([x for w in docs for x in (w, gap)] or [gap])
    edge = np.diff((ids > 0).view(np.int8), prepend=np.int8(0))
    a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)     # strings of known words
    del edge
    keep = b - a >= phrases.shortest
    a, b = a[keep], b[keep]
    if not len(a):
        return empty
    size = b - a + 1                                      # with the closing zero, at b
    at = np.concatenate([[0], np.cumsum(size)])
    offset = np.arange(at[-1]) - np.repeat(at[:-1], size)
    source = np.repeat(a, size) + offset
    index = FMIndex(ids[source], len(phrases.vocabulary) + 1, offset)
    del ids, offset
    cover = np.zeros(len(source) + 1, np.int64)           # of the strings alone: no phrase is found elsewhere
    found: list[set[str]] = [set() for _ in docs]
    for n, (windows, items) in phrases.by_length.items():
        lo, hi = index.ranges(windows)
        hits = np.flatnonzero(hi > lo)
        for block in np.array_split(hits, max(1, int((hi - lo)[hits].sum()) >> 20)):
            many = (hi - lo)[block]
            which = np.repeat(block, many)
            rows = np.repeat(lo[block], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            p = index.locate(rows)
            np.add.at(cover, p, 1)
            np.add.at(cover, p + n, -1)
            doc = np.searchsorted(starts, source[p], "right") - 1
            for pair in np.unique(doc * len(items) + which):
                found[pair // len(items)].update(items[pair % len(items)])
    hit = (np.cumsum(cover)[:-1] > 0).view(np.int8)       # never a closing zero, so spans stay in their string
    edge = np.diff(hit, prepend=np.int8(0), append=np.int8(0))
    for s, e in zip(source[np.flatnonzero(edge > 0)], source[np.flatnonzero(edge < 0) - 1] + 1):
        d = int(np.searchsorted(starts, s, "right")) - 1
        empty[d][1].append((int(s - starts[d]), int(e - starts[d])))
    return [(sorted(f), spans) for f, (_, spans) in zip(found, empty)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SCHEMA = "doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES,
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, items, spans): for every document the benchmark items of
    which a window of ``window`` words (or the whole of a shorter item) occurs,
    sorted as strings, and the merged word spans [start, end) to remove.

    Null and empty texts have no words; items without words or with a null
    item_id match nothing; repeated rows count as they come, equal item ids as
    one item. An empty benchmark hits nothing, an empty table gives an empty
    one. Other columns are not read. The benchmark goes out in broadcast blocks
    of at most ``block_bytes`` (and one item); for more than one block the
    passes are merged per document row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where(
        "id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    passes = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in own.collect()])
        passes.append(rows.mapInArrow(_searcher(phrases, window, shard_words, blocks > 1),
                                      SCHEMA + ", row_key long"))
    if blocks == 1:
        return passes[0].drop("row_key")
    union = passes[0]
    for p in passes[1:]:
        union = union.union(p)
    merged = stored(union.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"), (F.count("*") / blocks).cast("int").alias("copies")), "spans")

    def merge(batches):
        for batch in batches:
            d = batch.to_pylist()
            for r in d:
                r["spans"] = [{"start": s, "end": e} for s, e in merge_spans(
                    [(x["start"], x["end"]) for x in r["spans"]])]
            yield pa.RecordBatch.from_pylist(d, batch.schema)

    merged = merged.mapInArrow(merge, merged.schema)
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "doc_id", "n_words", "items", "spans")


def _searcher(items, window: int, shard_words: int, keyed: bool):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(span)), ("row_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        phrases = Phrases(items.value, window)
        ids, docs, keys, size = [], [], [], 0

        def result():
            rows = [{"doc_id": d, "n_words": len(w), "items": i,
                     "spans": [{"start": s, "end": e} for s, e in spans], "row_key": k}
                    for d, w, k, (i, spans) in zip(ids, docs, keys, search_numbers(docs, phrases))]
            return pa.RecordBatch.from_pylist(rows, schema)
        for batch in batches:
            for d, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids.append(d.as_py())
                docs.append(phrases.numbers(words_of(text)))
                keys.append(xxhash.xxh64_intdigest(text or "") - (1 << 63) if keyed else 0)
                size += len(docs[-1]) + 1
                if size >= shard_words:
                    yield result()
                    ids, docs, keys, size = [], [], [], 0
        if ids:
            yield result()
    return releasing(run)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))
