"""N-grams of token lists counted in Arrow batches.

The texts are cut into tokens there (``functions/words.py``); those of some documents are numbered by their own dictionary and an n-gram is the
number of its prefix and that of its last word, so only the n-grams that somebody asks for
become strings. Rows come sorted by id inside their partition; those of one id are one
document, but no n-gram reaches from one row into the next.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.words import tokenised
from .blocks import BLOCK_DOCS, matrix_row, narrow, wide

CHUNK_TOKENS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def whole_documents(batches: Iterator[pa.RecordBatch], most: int = CHUNK_TOKENS) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """(ids, document of each row, tokens, tokens a row) of about ``most`` tokens, from
    batches (id, tokens); all rows of an id come together."""
    kept = None
    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        code = np.asarray(batch.column(0).dictionary_encode(null_encoding="encode").indices)
        first = np.flatnonzero(np.diff(code, prepend=-1))                  # rows at which a document begins
        many = np.asarray(pc.list_value_length(batch.column(1)).fill_null(0), np.int64)
        before = np.concatenate([[0], np.cumsum(many)])[first]
        a = 0
        while a < len(first) - 1:                                          # the last one may go on
            b = min(max(a + 1, int(np.searchsorted(before, before[a] + most))), len(first) - 1)
            yield _rows(batch.slice(first[a], first[b] - first[a]), many[first[a]:first[b]], first[a:b] - first[a])
            a = b
        kept = batch.slice(first[-1])
    if kept is not None:
        yield _rows(kept, np.asarray(pc.list_value_length(kept.column(1)).fill_null(0), np.int64), np.zeros(1, np.int64))


def _rows(batch: pa.RecordBatch, many: np.ndarray, first: np.ndarray):
    document = np.zeros(batch.num_rows, np.int64)
    document[first[1:]] = 1
    return batch.column(0).take(pa.array(first)), np.cumsum(document), batch.column(1).flatten(), many


def positions(many: np.ndarray, n: int) -> np.ndarray:
    """Where an n-gram starts that ends in the same row."""
    left = np.repeat(np.cumsum(many), many) - np.arange(many.sum())
    return np.flatnonzero(left >= n)


def numbered(code: np.ndarray, kinds: int, many: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, numbers) of the n-grams of tokens with ``code`` below ``kinds``; equal
    numbers of one length are equal n-grams."""
    number, at, size = code, np.arange(len(code)), max(1, kinds)
    for n in range(1, hi + 1):
        if n > 1:
            if size * kinds >= 1 << 62:
                _, number = np.unique(number, return_inverse=True)
                size = len(number)
            full = np.zeros(len(code), np.int64)
            full[at] = number
            at = positions(many, n)
            number, size = full[at] * kinds + code[at + n - 1], size * kinds
        if n >= lo:
            yield n, at, number


def buckets_of(words: pa.Array, code: np.ndarray, at: np.ndarray, n: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at each start, the same in every batch."""
    own = hashes[code]
    with np.errstate(over="ignore"):
        h = own[at] + np.uint64(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _MIX + own[at + k]
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _coded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, number of each token's word, hash of each word)."""
    coded = tokens.dictionary_encode()
    words = coded.dictionary
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    return words, np.asarray(coded.indices, np.int64), hashes


CHUNK_BUCKETS = 1 << 16
COUNTS = "chunk int, counts binary"


def bucket_counts(lo: int, hi: int, buckets: int):
    """COUNTS of a partition: how many n-grams fall into each bucket, a row a chunk of
    buckets that has any."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, tokens, many in whole_documents(tokenised(batches)):
            words, code, hashes = _coded(tokens)
            for n in range(lo, hi + 1):
                at = positions(many, n)
                total += np.bincount(buckets_of(words, code, at, n, hashes, buckets), minlength=buckets)
        for k, at in enumerate(range(0, buckets, CHUNK_BUCKETS)):
            part = total[at:at + CHUNK_BUCKETS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([narrow(part)], pa.binary())], names=["chunk", "counts"])
    return run


def sum_counts(table: pa.Table) -> pa.Table:
    """One row of COUNTS from those of one chunk."""
    total = np.sum([wide(b) for b in table.column("counts").to_pylist()], axis=0)
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([narrow(total)], pa.binary())})


def strings(words: pa.Array, code: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    parts = [words.take(pa.array(code[at + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def term_stats(lo: int, hi: int, buckets: int = 0, chosen=None):
    """(term, df, ctf) of the n-grams in the chosen buckets (packed bits, broadcast; None:
    of all), a row a chunk of documents that has them."""
    def run(batches):
        wanted = None if chosen is None else np.unpackbits(chosen.value, count=buckets).astype(bool)
        for _, document, tokens, many in whole_documents(tokenised(batches)):
            words, code, hashes = _coded(tokens)
            own = np.repeat(document, many)
            for n, at, number in numbered(code, len(words), many, lo, hi):
                if wanted is not None:
                    inside = wanted[buckets_of(words, code, at, n, hashes, buckets)]
                    at, number = at[inside], number[inside]
                if not len(at):
                    continue
                coded = pa.array(number).dictionary_encode()
                kinds, gram = len(coded.dictionary), np.asarray(coded.indices, np.int64)
                one = np.empty(kinds, np.int64)
                one[gram] = at                                             # any place of each
                pairs = np.unique(own[at] * kinds + gram)
                yield pa.RecordBatch.from_arrays(
                    [strings(words, code, one, n).cast(pa.string()), pa.array(np.bincount(pairs % kinds, minlength=kinds)),
                     pa.array(np.bincount(gram, minlength=kinds))], names=["term", "df", "ctf"])
    return run


MAYBE_BITS = 20                # of the filter before the search for a key


def _spread(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)


def _where(condition: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.flatnonzero(condition)
    return tuple(a[at] for a in arrays)


class Vocabulary:
    """Terms found by the numbers of their words."""

    def __init__(self, terms: list[str], lo: int, hi: int):
        split = [t.split(" ") for t in terms]
        self.words = pa.array(sorted({w for s in split for w in s}), pa.string())
        self.base = len(self.words) + 1
        place = {w: i + 1 for i, w in enumerate(self.words.to_pylist())}
        self.tables = {}
        for n in range(lo, hi + 1):
            own = [i for i, s in enumerate(split) if len(s) == n]
            key = np.array([self._key([place[w] for w in split[i]]) for i in own], np.int64)
            order = np.argsort(key)
            maybe = np.zeros(1 << MAYBE_BITS, bool)
            maybe[_spread(key)] = True
            self.tables[n] = key[order], np.array(own, np.int64)[order], maybe

    def _key(self, parts: list[int]) -> int:
        key = 0
        for p in parts:
            key = key * self.base + p
        return key

    def found(self, tokens: pa.Array, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, terms) of the n-grams in the vocabulary."""
        coded = tokens.dictionary_encode()
        place = np.asarray(pc.index_in(coded.dictionary, self.words).fill_null(-1), np.int64) + 1
        code = place[np.asarray(coded.indices, np.int64)]
        left = np.repeat(np.cumsum(many), many) - np.arange(len(code))
        at = np.flatnonzero(code)
        key = code[at]
        for n in range(1, max(self.tables, default=0) + 1):
            if n > 1:                                                      # starts of n known words
                at, key = _where(left[at] >= n, at, key)
                at, key, word = _where(code[at + n - 1] > 0, at, key, code[at + n - 1])
                key = key * self.base + word
            if n not in self.tables or not len(self.tables[n][0]):
                continue
            keys, terms, maybe = self.tables[n]
            starts, own = _where(maybe[_spread(key)], at, key)
            spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[spot] == own
            yield starts[hit], terms[spot[hit]]


def counted(vocabulary, lo: int, hi: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, document, place of the term, occurrences), sorted by document and place, of
    chunks of documents; ``vocabulary`` is an Arrow table (term, term_id, idf)."""
    found = Vocabulary(vocabulary.column("term").to_pylist(), lo, hi)
    size = max(1, vocabulary.num_rows)
    for ids, document, tokens, many in whole_documents(tokenised(batches)):
        own = np.repeat(document, many)
        pairs = [own[at] * size + terms for at, terms in found.found(tokens, many)]
        pair, tf = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
        yield ids, pair // size, pair % size, tf


def weights_of(vocabulary, lo: int, hi: int):
    """(article_id, term_id, tfidf) of unit length a document; ``vocabulary`` is a broadcast
    Arrow table (term, term_id, idf)."""
    def run(batches):
        table = vocabulary.value
        idf, term_id = table.column("idf").to_numpy(), table.column("term_id").to_numpy()
        for ids, doc, term, tf in counted(table, lo, hi, batches):
            if not len(doc):
                continue
            w = tf * idf[term]
            norm = np.sqrt(np.bincount(doc, w * w, minlength=len(ids)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), pa.array(term_id[term]), pa.array(w / norm[doc])],
                names=["article_id", "term_id", "tfidf"])
    return run


def blocks_of(vocabulary, lo: int, hi: int):
    """Rows of ``blocks.PACKED`` from sorted texts: the same matrix as ``weights_of`` gives,
    held as occurrences. ``vocabulary`` has its rows in the order of term_id. Documents
    without an id have no row in X and count in ``squares`` only."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for ids, doc, term, tf in counted(vocabulary.value, lo, hi, batches):
            documents = len(ids)
            first = np.searchsorted(doc, np.arange(documents + 1))
            squares = np.diff(first) > 0                                    # a row of X has unit length
            for at in range(0, documents, BLOCK_DOCS):
                end = min(at + BLOCK_DOCS, documents)
                part = ids[at:end]
                known = np.asarray(pc.is_valid(part))
                own = np.repeat(known, np.diff(first[at:end + 1]))
                yield matrix_row(number, part.filter(pa.array(known)), np.diff(first[at:end + 1])[known],
                                 term[first[at]:first[end]][own], tf[first[at]:first[end]][own], float(squares[at:end].sum()))
                number += 1
    return run
