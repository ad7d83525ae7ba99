"""Words of whole texts in Arrow batches: bytes are looked up and cut with NumPy, the
words themselves stay Arrow strings. Spark deals the texts and ships the batches."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
PART_BYTES = 1 << 17             # looked up at once: its arrays stay in a core's cache
_SPACE = pa.scalar(" ", pa.large_string())
_BLANKS = bytes([*range(9, 14), *range(28, 32), 32])         # the class WHITESPACE


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` bytes of text, at least one row each."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)) + 1
        yield a, min(b, len(texts))
        a = b


def spaced_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the texts, nulls as empty, a space after each."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), _SPACE)
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut(packed: bytes, solid: np.ndarray, first: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The words that begin at ``begin`` (the places of ``first``), made of the bytes that
    are ``solid``; ``packed`` holds these bytes alone."""
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    bounds = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=bounds[1:])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(packed))


def starts_of(solid: np.ndarray) -> np.ndarray:
    """Where a run begins, as a mask."""
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    return begin


def listed(words: pa.Array, keep: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words that are kept, as a list a text."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return pa.LargeListArray.from_arrays(pa.array(before[np.searchsorted(begin, starts)]), words.filter(pa.array(keep)))


def cleaner(punctuation: str, stopwords: list[str], splits: list[tuple[str, str]], spaced: set[tuple[str, str]]):
    """A function of texts: their words, lower-cased, without punctuation and stopwords,
    joined by a space. Bytes beyond ASCII are blanks; the ``splits`` are cut where the
    whole word is met (those ``spaced``: before ``a`` and a space)."""
    fold = bytes(c + 32 if 65 <= c < 91 else c if c < 128 else 32 for c in range(256))
    punctuation = punctuation.encode()
    gone = np.isin(np.arange(256), list(punctuation))
    full = bytes(c not in _BLANKS for c in range(256))
    letters = set(b"abcdefghijklmnopqrstuvwxyz0123456789_")
    stop = pa.array(stopwords, pa.large_string())

    def part(texts: pa.Array) -> pa.Array:
        data, starts = spaced_bytes(texts)
        starts = starts - np.searchsorted(np.flatnonzero(gone[data]), starts)
        whole = data.tobytes().translate(fold, punctuation)
        solid = np.frombuffer(whole.translate(full), bool)
        first = starts_of(solid)
        for a, b in splits:
            word = (a + b).encode()
            at = whole.find(word)
            while at >= 0:
                after = whole[at + len(word)]              # every text ends with a space
                if (at == 0 or whole[at - 1] not in letters) and (after == 32 if (a, b) in spaced else after not in letters):
                    first[at + len(a)] = True
                at = whole.find(word, at + 1)
        begin = np.flatnonzero(first)
        words = cut(whole.translate(None, _BLANKS), solid, first, begin)
        kept = ~np.asarray(pc.is_in(words, stop))
        return pc.binary_join(listed(words, kept, begin, starts), _SPACE)

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.string())
        made = pa.concat_arrays([part(texts[a:b]).cast(pa.string()) for a, b in slices(texts, PART_BYTES)])
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), made)
    return run


_VECTOR = bytes(c in b"abcdefghijklmnopqrstuvwxyz0123456789" for c in range(256))
_NO_VECTOR = bytes(c for c in range(256) if not _VECTOR[c])


def vector_words(texts: pa.Array) -> pa.Array:
    """The lists of ``vector_tokens``: runs of two and more of a-z and 0-9."""
    parts = [_vector_words(texts[a:b]) for a, b in slices(texts, PART_BYTES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_list(pa.large_string()))


def _vector_words(texts: pa.Array) -> pa.Array:
    data, starts = spaced_bytes(texts)
    whole = data.tobytes()
    solid = np.frombuffer(whole.translate(_VECTOR), bool)
    first = starts_of(solid)
    begin = np.flatnonzero(first)
    words = cut(whole.translate(None, _NO_VECTOR), solid, first, begin)
    return listed(words, np.asarray(pc.binary_length(words), np.int64) >= 2, begin, starts)


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) of batches (id, text), in slices of them."""
    kind = pa.list_(pa.string())
    for batch in batches:
        for a, b in slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], vector_words(batch.column(1)[a:b]).cast(kind)],
                                             names=["article_id", "toks"])
