"""Removal of repeated passages by a distributed, prefix-aware merge sort of suffixes.

Suffixes are taken at anchors: of every 50-byte window the place of its smallest
16-byte hash. Two equal windows have the same anchor, so nothing is missed, and
about one position in eighteen is an anchor. Anchors whose hash occurs in one
document only are set aside first, by an exchange of packed hashes.

The others are sorted: each task sorts the suffixes of its documents into a run
and sends it, front-coded and cut at sampled splitters, to the tasks that hold
those ranges of the order. A task merges its runs with a loser tree whose nodes
know the prefix they share with the last suffix put out, so no known prefix is
compared again, and the merge yields the common prefixes of neighbours for free.
From these and from the bytes before each anchor it reads off every 50-byte
string through an anchor and the smallest document it starts in.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8_parts
from .dartminhash import mix

LENGTH, KMER = 50, 16
LEFT = LENGTH - KMER                                    # an anchor lies at most so far into a window
BUCKET_BYTES = 4 << 20                                  # text bytes behind one bucket of hashes
RUN = 200_000                                           # suffixes of one run
MERGE = 100_000                                         # suffixes of one merge, about
SPLITTER_DOCS = 2000                                    # documents sampled for the splitters, at most
LAST = (1 << 63) - 1                                    # order of a null doc_id
_U = np.uint64


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of documents data[start:end], ascending."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    a = data.astype(_U)
    for k in (1, 2, 4):
        a = a[:-k] | a[k:] << _U(8 * k)
    with np.errstate(over="ignore"):
        h = mix(a[:-8] * _U(0x9E3779B97F4A7C15) + a[8:] * _U(0xC2B2AE3D27D4EB4F))
    m = h & ~_U(0xFFFFFFFF) | np.arange(len(h), dtype=_U)        # leftmost of equal hashes
    w = 1
    while 2 * w <= LEFT + 1:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if w < LEFT + 1:
        m = np.minimum(m[:-(LEFT + 1 - w)], m[LEFT + 1 - w:])
    outside = np.zeros(n + 1, np.int32)
    np.add.at(outside, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(outside, ends, -1)
    inside = np.cumsum(outside)[:len(m)] == 0
    at = (m[inside] & _U(0xFFFFFFFF)).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return at, h[at]


def _chunks(lengths: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def _pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length, bytes of equal weight together, compressed."""
    import zstandard
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays)
    return struct.pack("<I", len(arrays[0])) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    import zstandard
    n = struct.unpack("<I", data[:4])[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    out, at = [], 0
    for d in map(np.dtype, dtypes):
        out.append(np.ascontiguousarray(raw[at:at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).reshape(n))
        at += n * d.itemsize
    return out


SINGLE, REPEATED, SETTLED = 0, 1, 2


def hash_exchange(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload): packed anchors (hash, uid, position, state). A hash met in
    several documents of a batch is settled there: its anchors pass through
    spread over all buckets, and one entry tells the hash's own bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8_parts(batch.column(1))
            got = []
            for a, b in _chunks(np.diff(offsets)):
                lo = offsets[a]
                at, h = anchors(data[lo:offsets[b]], offsets[a:b] - lo, offsets[a + 1:b + 1] - lo)
                doc = np.searchsorted(offsets, at + lo, "right") - 1
                got.append((h, doc, at + lo - offsets[doc]))
            if not got:
                continue
            h, doc, at = (np.concatenate(x) for x in zip(*got))
            with np.errstate(over="ignore"):
                h = mix(h + _U(0x9E3779B97F4A7C15))
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order]
            if not len(h):
                continue
            first = np.flatnonzero(np.diff(h, prepend=h[0] + _U(1)))
            size = np.diff(first, append=len(h))
            many = np.minimum.reduceat(uid[doc], first) != np.maximum.reduceat(uid[doc], first)
            settled = np.repeat(many, size)
            state = np.where(settled, SETTLED, SINGLE).astype(np.uint8)
            bucket = (h % _U(buckets)).astype(np.int64)
            bucket[settled] = (doc[settled] * 31 + at[settled]) % buckets
            tell = first[many]
            h, doc, at = np.append(h, h[tell]), np.append(doc, doc[tell]), np.append(at, at[tell])
            state = np.append(state, np.full(len(tell), REPEATED, np.uint8))
            bucket = np.append(bucket, (h[len(order):] % _U(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key = (h >> _U(32)).astype(np.uint32)
            rows = []
            for k in np.flatnonzero(np.diff(cut)):
                o = order[cut[k]:cut[k + 1]]
                rows.append((int(k), _pack(key[o], uid[doc[o]], at[o].astype(np.uint32), state[o])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    return docs.select("uid", "text").mapInArrow(run, "bucket long, payload binary")


def repeated_anchors(exchanged: DataFrame) -> DataFrame:
    """(uid, at) of the anchors whose hash occurs in more than one document."""
    def settle(t: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py(), np.uint32, np.int64, np.uint32, np.uint8) for p in t.column("payload")]
        key, uid, at, state = (np.concatenate(x) for x in zip(*parts))
        through = state == SETTLED
        own = np.flatnonzero(~through)
        own = own[np.argsort(key[own], kind="stable")]
        keep = [np.flatnonzero(through)]
        if len(own):
            first = np.flatnonzero(np.diff(key[own].astype(np.int64), prepend=-1))
            size = np.diff(first, append=len(own))
            many = np.minimum.reduceat(uid[own], first) != np.maximum.reduceat(uid[own], first)
            many |= np.maximum.reduceat(state[own], first) == REPEATED
            chosen = own[np.repeat(many, size)]
            keep.append(chosen[state[chosen] == SINGLE])
        o = np.concatenate(keep)
        return pa.table({"uid": uid[o], "at": at[o].astype(np.int64)})

    return exchanged.groupBy("bucket").applyInArrow(settle, "uid long, at long")


def contexts(batch: pa.RecordBatch):
    """Arrays of all anchors of a batch (uid, ord, text, ats): right contexts padded
    to 50 bytes with their lengths, left ones to 34 (nearest byte last)."""
    data, offsets = utf8_parts(batch.column(2))
    ats = batch.column(3)
    many = np.diff(np.asarray(ats.offsets))
    doc = np.repeat(np.arange(batch.num_rows), many)
    at = np.asarray(ats.flatten()).astype(np.int64)
    pos, begin, end = offsets[doc] + at, offsets[doc], offsets[doc + 1]
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    right = padded[(pos + LEFT)[:, None] + np.arange(LENGTH)]
    rlen = np.minimum(end - pos, LENGTH)
    right[np.arange(LENGTH) >= rlen[:, None]] = 0
    left = padded[pos[:, None] + np.arange(LEFT)]
    llen = np.minimum(pos - begin, LEFT)
    left[np.arange(LEFT, 0, -1) > llen[:, None]] = 0
    uid = batch.column(0).to_numpy(zero_copy_only=False)[doc]
    order = batch.column(1).to_numpy(zero_copy_only=False)[doc]
    return right, rlen.astype(np.uint8), left, llen.astype(np.uint8), uid, order, at.astype(np.uint32)


def _words(right: np.ndarray) -> list[np.ndarray]:
    padded = np.zeros((len(right), 56), np.uint8)
    padded[:, :LENGTH] = right
    w = padded.view(">u8").astype(_U)
    return [w[:, k] for k in range(7)]


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def encode_run(right, rlen, left, llen, uid, order, at) -> bytes:
    """A sorted run, front-coded: common prefix with the one before, the other bytes."""
    import zstandard
    lcp = np.zeros(len(right), np.uint8)
    lcp[1:] = common_prefix(right[1:], right[:-1])
    tails = right[np.arange(LENGTH) >= lcp[:, None]].tobytes()
    own = left[np.arange(LEFT, 0, -1) <= llen[:, None]].tobytes()
    head = _pack(lcp, rlen, llen, uid, order, at)
    body = zstandard.ZstdCompressor(level=1).compress(tails + own)
    return struct.pack("<II", len(head), len(tails)) + head + body


def decode_run(data: bytes):
    import zstandard
    n_head, n_tails = struct.unpack("<II", data[:8])
    lcp, rlen, llen, uid, order, at = _unpack(data[8:8 + n_head], np.uint8, np.uint8, np.uint8, np.int64, np.int64,
                                              np.uint32)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + n_head:]), np.uint8)
    left = np.zeros((len(lcp), LEFT), np.uint8)
    left[np.arange(LEFT, 0, -1) <= llen[:, None]] = body[n_tails:]
    return lcp, rlen, left, llen, uid, order, at, body[:n_tails].tobytes()


def run_keys(lcp: np.ndarray, tails: bytes) -> list[int]:
    """Suffixes of a front-coded run as numbers of 50 bytes."""
    out, at, key = [], 0, 0
    for c in lcp.tolist():
        rest = LENGTH - c
        key = (key >> 8 * rest << 8 * rest) | int.from_bytes(tails[at:at + rest])
        out.append(key)
        at += rest
    return out


def merge_runs(runs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser tree over sorted runs of (keys, common prefix with the one before).

    Returns (run, index, common prefix with the suffix put out before) in merged
    order. Every candidate carries the length of the prefix it shares with the
    last suffix put out: the longer one is the smaller, and only equal lengths
    look at the keys. Equal suffixes come in run order.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefix = [r[1] for r in runs]
    sizes = [len(x) for x in keys]
    bits = 8 * LENGTH
    at = [0] * k
    known = [0 if n else -1 for n in sizes]             # of each run's candidate; -1: the run is empty
    loser = [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        """(smaller, larger) candidate; updates the larger one's known prefix."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = keys[a][at[a]], keys[b][at[b]]
        if x < y or x == y and a < b:
            known[b] = (bits - (x ^ y).bit_length()) >> 3
            return a, b
        known[a] = (bits - (x ^ y).bit_length()) >> 3
        return b, a

    winners = list(range(k))
    for level in range(k.bit_length() - 1):             # leaves to root
        base = k >> (level + 1)
        up = []
        for i in range(0, len(winners), 2):
            w, l = first(winners[i], winners[i + 1])  # noqa: E741
            loser[base + i // 2] = l
            up.append(w)
        winners = up
    w = winners[0]
    total = sum(sizes)
    out_run, out_at, out_lcp = [0] * total, [0] * total, [0] * total
    for n in range(total):
        i = at[w]
        out_run[n], out_at[n], out_lcp[n] = w, i, known[w]
        i += 1
        at[w] = i
        known[w] = prefix[w][i] if i < sizes[w] else -1
        node = (w + k) >> 1
        while node:
            o = loser[node]
            kw, ko = known[w], known[o]
            if kw < ko:
                loser[node], w = w, o
            elif kw == ko and kw >= 0:
                x, y = keys[w][at[w]], keys[o][at[o]]
                shared = (bits - (x ^ y).bit_length()) >> 3
                if y < x or x == y and o < w:
                    known[w] = shared
                    loser[node], w = w, o
                else:
                    known[o] = shared
            node >>= 1
    return np.array(out_run), np.array(out_at), np.array(out_lcp)


def removable(lcp, rlen, left, llen, order) -> np.ndarray:
    """For every suffix of a merged range and l = 0..34: whether the 50-byte string
    that starts l bytes before it also does in a smaller document.

    Two such strings are equal if the suffixes share 50 - l bytes (neighbours
    in the order, by the common prefixes) and the l bytes before them agree (a
    64-bit hash, byte by byte)."""
    n = len(lcp)
    out = np.zeros((n, LEFT + 1), bool)
    near = np.cumsum(lcp < KMER)
    rows = np.flatnonzero(np.bincount(near)[near] > 1)  # alone with its 16 bytes: nothing to find
    if not len(rows):
        return out
    # positions between kept rows stay in the common prefix: a range minimum of neighbours
    group = near[rows]
    h = np.zeros(len(rows), _U)
    order, rlen, llen = order[rows], rlen[rows].astype(np.int64), llen[rows].astype(np.int64)
    lcp, left = lcp[rows], left[rows]
    lcp = np.where(np.diff(group, prepend=-1) != 0, 0, lcp)
    with np.errstate(over="ignore"):
        for back in range(LEFT + 1):
            if back:
                h = mix(h * _U(0x9E3779B97F4A7C15) + left[:, LEFT - back].astype(_U) + _U(1))
            fit = np.flatnonzero((llen >= back) & (rlen >= LENGTH - back))
            if not len(fit):
                continue
            same = np.cumsum(lcp < LENGTH - back).astype(_U)
            key = mix(same[fit] * _U(0xD6E8FEB86659FD93) ^ h[fit])
            _, which = np.unique(key, return_inverse=True)
            least = np.full(which.max() + 1, LAST, np.int64)
            np.minimum.at(least, which, order[fit])
            out[rows[fit], back] = order[fit] > least[which]
    return out


def spans_of_mask(mask: np.ndarray, uid: np.ndarray, at: np.ndarray) -> pa.Table:
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)                     # strings lo..hi-1 bytes before the anchor
    _, hi = np.nonzero(edge == -1)
    at = at[row].astype(np.int64)
    return pa.table({"uid": uid[row], "start": at - (hi - 1), "end": at - lo + LENGTH})


def exchange_runs(chosen: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(bucket, payload): each task's sorted runs, cut at the splitters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            right, *rest = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort(_words(right)[::-1])
            right, rest = right[order], [x[order] for x in rest]
            keys = right.view(f"S{LENGTH}").ravel()
            cut = [0, *np.searchsorted(keys, np.array(splitters, f"S{LENGTH}")), len(keys)] if splitters else [
                0, len(keys)]
            found = [(k, a, b) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in found], pa.int64()),
                 pa.array([encode_run(right[a:b], *(x[a:b] for x in rest)) for _, a, b in found], pa.binary())],
                names=["bucket", "payload"])
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = contexts(batch.slice(a, 500))
                held.append(part)
                size += len(part[0])
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return chosen.select("uid", "ord", "text", "ats").mapInArrow(run, "bucket long, payload binary")


def merged_spans(exchanged: DataFrame) -> DataFrame:
    """(uid, start, end): bytes to remove, one row per anchor and stretch."""
    def merge(t: pa.Table) -> pa.Table:
        runs = [decode_run(p.as_py()) for p in t.column("payload")]
        which, index, lcp = merge_runs([(run_keys(r[0], r[-1]), r[0].tolist()) for r in runs])
        at = index + np.cumsum([0, *(len(r[0]) for r in runs)])[which]
        rlen, left, llen, uid, order, pos = (np.concatenate([r[k] for r in runs])[at] for k in range(1, 7))
        lcp = np.minimum(lcp, np.minimum(rlen, np.concatenate([[0], rlen[:-1]])))
        return spans_of_mask(removable(lcp, rlen, left, llen, order), uid, pos)

    return exchanged.groupBy("bucket").applyInArrow(merge, "uid long, start long, end long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): whole texts as UTF-8 bytes (null: empty)
    without each byte covered by a 50-byte string that also starts in a document
    with a smaller doc_id; ``spans`` are the removed runs, ``kept`` the other
    bytes.

    Null ids count as one document after all others; rows with one doc_id are
    one document, never smaller than itself, and are judged each by its own
    text. Shorter texts stay whole, an empty table gives an empty one, other
    columns are not read.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
                      F.coalesce("text", F.lit("")).alias("text"))
    sizes = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    unique = own.select("ord").distinct().count() == sizes["n"]
    if unique:
        own = own.withColumn("uid", F.col("ord"))
    else:                                               # rows need a name of their own
        own = stored(own.withColumn("uid", F.monotonically_increasing_id()), "repeats-rows")
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")
    ids = stored(own.select("uid", "ord", *hashes, F.octet_length("text").cast("long").alias("n_bytes")), "repeats-ids")
    first = ids.groupBy("h1", "h2").agg(F.min(F.struct("ord", "uid")).alias("rep"))
    roles = stored(ids.join(first, ["h1", "h2"]).select(
        "uid", "ord", "n_bytes", F.col("rep.uid").alias("rep"), (F.col("ord") > F.col("rep.ord")).alias("copy")),
        "repeats-roles")
    buckets = max(1, -(-(sizes["bytes"] or 0) // BUCKET_BYTES))
    found = repeated_anchors(hash_exchange(own, buckets))
    grouped = stored(found.groupBy("uid").agg(F.collect_set("at").alias("ats"))
                     .join(roles.where("uid = rep").select("uid"), "uid", "left_semi"), "repeats-anchors")
    n = grouped.agg(F.sum(F.size("ats"))).first()[0] or 0
    merges = max(1, -(-n // MERGE))
    chosen = own.join(grouped, "uid")
    splitters = sample_splitters(own, grouped, merges) if merges > 1 else []
    spans = (merged_spans(exchange_runs(chosen, splitters)).groupBy("uid")
             .agg(F.collect_list(F.struct("start", "end")).alias("found")))
    plan = roles.join(spans.withColumnRenamed("uid", "rep"), "rep", "left").select(
        "uid", "copy", "found")
    return cut(own.join(stored(plan, "repeats-spans"), "uid"))


def sample_splitters(own: DataFrame, grouped: DataFrame, parts: int) -> list[bytes]:
    """Splitters of the suffix order from a bounded sample of documents, at most 64
    suffixes each. They only balance the merges: equal strings share the 16 bytes of
    their anchor at least, and no cut falls between two suffixes with the same 16."""
    few = grouped.orderBy(F.xxhash64("uid"), "uid").limit(SPLITTER_DOCS)
    few = few.withColumn("ats", F.slice("ats", 1, 64))
    rows = own.join(F.broadcast(few), "uid").select("uid", "ord", "text", "ats")   # SPLITTER_DOCS rows

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in contexts(batch)[0]], pa.binary())],
                                                 names=["key"])
    keys = sorted(r["key"] for r in rows.mapInArrow(run, "key binary").collect())
    cuts = {keys[i * len(keys) // parts][:KMER].rstrip(b"\0") for i in range(1, parts)} if keys else set()
    return sorted(cuts)


def cut(planned: DataFrame) -> DataFrame:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)),
                        ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for order, text, copy, found in zip(*batch.columns):
                data, spans, kept, at = (text.as_py() or "").encode(), [], [], 0
                if copy.as_py():
                    found = [(0, len(data))] if len(data) >= LENGTH else []
                else:
                    found = sorted((f["start"], f["end"]) for f in found.as_py() or ())
                for s, e in found:
                    if spans and s <= spans[-1]["end"]:
                        spans[-1]["end"] = max(e, spans[-1]["end"])
                    else:
                        spans.append({"start": s, "end": e})
                for s in spans:
                    kept.append(data[at:s["start"]])
                    at = s["end"]
                kept.append(data[at:])
                order = order.as_py()
                rows.append({"doc_id": None if order == LAST else order, "n_bytes": len(data), "spans": spans,
                             "kept": b"".join(kept)})
                size += len(data)
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return planned.select("ord", "text", "copy", "found").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
