"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is a weighted set of five-word shingles. Darts are thrown at the plane
(weight, rank) of every element: the darts of an element and of one region of
its weight axis (weights 0 to 1, then doublings) come in order of rank with
exponential gaps drawn from a hash, each at a hashed weight. A set owns the
darts under its weights. Every dart belongs to one of the signature's
coordinates, and a coordinate keeps its earliest dart; two sets agree on a
coordinate with probability equal to their weighted Jaccard similarity. Only
darts up to a rank threshold inverse to the total weight are drawn, so a long
text costs its shingles plus about k ln k darts.

Equal texts form one class first. Classes that agree on a whole band are
candidates; each is compared with the smallest of its bucket by exact
similarity, and where a bucket then still holds several components, their
members are compared across components (by sketch, then exactly) until they are
connected. So every pair of a bucket is either compared or connected, and no
bucket lists all its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, connected_components, release, stored
from .fmindex import words_of

WORDS = 5
SIMILARITY = 0.8
COORDINATES, BANDS = 128, 32
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 21      # members and elements of a bucket's block
BROADCAST_IDS = 4_000_000                  # ids sent to the texts at most (32 MB of longs)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASH = _WordHash()


def forget() -> None:
    _HASH.clear()
    release()


def forgetting(run):
    """``run`` with the words' hashes dropped at its end: Spark keeps the worker and its
    memory for later tasks, and while the JVM alone is at work."""
    def until_done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()               # by its name: a task's own function has copies of the globals it names
    return until_done


def shingles(text: str | None, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs. A text of fewer
    words, but not none, is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASH.__getitem__, words), _U, len(words))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, _U)
        for k in range(n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[k:k + len(out)])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """One row of ``k`` dart ids per non-empty weighted set (element hashes, weights);
    rows of empty sets are zero."""
    out = np.zeros((len(sets), k), _U)
    todo = np.array([i for i, (e, _) in enumerate(sets) if len(e)], np.int64)
    darts = k * np.log(k) + 2 * k                    # expected; coordinates seldom stay empty
    while len(todo):
        best = np.full(len(todo) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(float)
        sizes = [len(sets[i][0]) for i in todo]
        owner = np.repeat(np.arange(len(todo)), sizes)
        total = np.add.reduceat(weights, np.cumsum([0, *sizes[:-1]]))
        limit = (darts / total)[owner]
        for region in range(int(np.ceil(np.log2(max(1.0, weights.max())))) + 1):
            low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
            inside = weights > low
            _throw(elements[inside], weights[inside], owner[inside], limit[inside], region, low, width, best, k)
        rows = best.reshape(len(todo), k)
        full = (rows != np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)
        out[todo[full]] = rows[full]
        todo, darts = todo[~full], darts * 2
    return out & _U(0xFFFFFF)


def _throw(elements, weights, owner, limit, region, low, width, best, k) -> None:
    """Darts of one region in order of rank, until each element passes its limit. The
    packed value orders by rank (40 leading bits) and carries 24 bits of the id."""
    rank, turn = np.zeros(len(elements)), 0
    with np.errstate(over="ignore"):
        state = mix(elements ^ _U((region * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
        while len(state):
            turn += 1
            state = mix(state + _U(0x9E3779B97F4A7C15))
            rank = rank - np.log1p(-(state >> _U(11)).astype(float) * 2.0 ** -53) / width
            alive = rank <= limit
            if not alive.all():
                state, rank, owner, limit, weights = (x[alive] for x in (state, rank, owner, limit, weights))
            other = mix(state ^ _U(0xD1B54A32D192ED03))
            hit = low + (other >> _U(40)).astype(float) * 2.0 ** -24 * width < weights
            identity = mix(other + _U(0x8CB92BA72F3D8DD7))
            packed = (rank.view(_U) << _U(1) & ~_U(0xFFFFFF)) | (identity & _U(0xFFFFFF))
            slot = owner * k + ((identity >> _U(32)) % _U(k)).astype(np.int64)
            np.minimum.at(best, slot[hit], packed[hit])


def _weigh(text: str | None, weights: str) -> tuple[np.ndarray, np.ndarray]:
    h, n = shingles(text)
    return (h, n) if weights == "count" else (h, np.ones(len(h), np.int64))


def sign(docs: DataFrame, weights: str, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(doc_id, h1, h2, bands array<long>, sketch binary) per row; no bands for texts
    without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                ids, texts = (c[a:b].to_pylist() for c in batch.columns)
                sets = [_weigh(t, weights) for t in texts]
                sig = signatures(sets, k)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(bands, dtype=_U), (len(ids), bands)).copy()
                    for r in sig.reshape(len(ids), bands, k // bands).transpose(2, 0, 1):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + r)
                key, sketch = key.view(np.int64), (sig & _U(255)).astype(np.uint8)
                h = [xxhash.xxh3_128_intdigest((t or "").encode()) for t in texts]
                half = 1 << 63
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([(x >> 64) - half for x in h]),
                     pa.array([(x & (2 * half - 1)) - half for x in h]),
                     pa.array([row if len(s[0]) else [] for row, s in zip(key.tolist(), sets)], pa.list_(pa.int64())),
                     pa.array([row.tobytes() for row in sketch])], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        forgetting(run), "doc_id long, h1 long, h2 long, bands array<long>, sketch binary")


def weighted_sets(docs: DataFrame, weights: str) -> DataFrame:
    """(id, elements array<long>, weights array<long>) of texts; no weights where every
    element weighs one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                ids, texts = (c[a:b] for c in batch.columns)
                sets = [_weigh(t, weights) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([s[0].view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([s[1] if weights == "count" else None for s in sets], pa.list_(pa.int64()))],
                    names=["id", "elements", "weights"])
    return docs.mapInArrow(forgetting(run), "id long, elements array<long>, weights array<long>")


def of_ids(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` is among the stored ``ids``. Up to BROADCAST_IDS ids are
    sent to the rows, so these do not move; more meet them in a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), name, "left_semi")


def alike(pairs: DataFrame, sketches: DataFrame, need: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree on at least ``need`` coordinates."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("sketch").alias("s" + s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= need))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long").distinct())


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of class ids whose exact weighted Jaccard similarity is at
    least ``least``."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("elements").alias("e" + s),
                                 F.col("weights").alias("w" + s))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (_set_at(batch, i, s) for s in "ab")
                keep.append(bool(jaccard_at_least(x, y, least)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return joined.select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, "a long, b long").distinct()


def _set_at(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray, int]:
    e, w = np.asarray(batch.column("e" + side)[i].values), batch.column("w" + side)[i].values
    w = np.ones(len(e), np.int64) if w is None else np.asarray(w)
    return e, w, w.sum()


def jaccard_at_least(x, y, least: float) -> bool:
    """Exact weighted Jaccard of two sorted (elements, weights) against ``least``."""
    (ea, wa, ta), (eb, wb, tb) = x, y
    if min(ta, tb) < least * max(ta, tb):
        return False
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[ia], wb[ib]).sum()
    return shared >= least * (ta + tb - shared)


def agreement(k: int, least: float) -> float:
    """Coordinates on which sketches of sets as similar as ``least`` agree, less five
    standard deviations."""
    return k * max(0.0, least - 5 * (least * (1 - least) / k) ** 0.5)


def across(rows: DataFrame, sets: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b) between members of a bucket (key, id, component, sketch; their
    stored sets) that are in different components, enough of them to connect all
    that are linked: a pair is skipped once its ends are connected, and compared
    exactly if the sketches come within five standard deviations of ``least``.
    Large buckets are cut into blocks by members and elements; each pair of
    blocks is one group, and a group returns fewer links than it has members.
    Blocks are dealt before the sets join, which so move to their groups only."""
    need = agreement(k, least)
    held = sets.groupBy("id").agg(F.sum(F.size("elements")).alias("held"))
    slim = stored(rows.join(held, "id"), "minhash-members")
    size = slim.groupBy("key").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    cut = (slim.join(size, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                   "id", "component", "sketch")
           .join(sets, "id"))

    def compare(t: pa.Table) -> pa.Table:
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        _, root = np.unique(t.column("component").to_numpy(), return_inverse=True)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        e, w = t.column("elements").combine_chunks(), t.column("weights").combine_chunks()
        _, element = np.unique(np.asarray(e.flatten()), return_inverse=True)
        weight = np.ones(len(element), np.int64) if w.null_count else np.asarray(w.flatten())
        ends = np.cumsum([0, *pc.list_value_length(e).to_pylist()])
        total = np.add.reduceat(weight, ends[:-1])
        own = np.zeros(element.max() + 1, weight.dtype)
        two = t.column("i")[0] != t.column("j")[0]
        a, b = [], []
        for x in range(len(ids)):
            other = np.flatnonzero((root != root[x]) & (block > block[x] if two else np.arange(len(ids)) > x))
            other = other[(sketch[other] == sketch[x]).sum(1) >= need]
            if not len(other):
                continue
            mine = slice(ends[x], ends[x + 1])
            own[element[mine]] = weight[mine]             # weights of x by element, then shared ones of the others
            many = ends[other + 1] - ends[other]
            at = np.cumsum(many) - many
            taken = np.arange(many.sum()) - np.repeat(at - ends[other], many)
            shared = np.add.reduceat(np.minimum(own[element[taken]], weight[taken]), at)
            own[element[mine]] = 0
            for y in other[shared >= least * (total[x] + total[other] - shared)].tolist():
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    a.append(ids[x])
                    b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return cut.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set", k: int = COORDINATES,
                    bands: int = BANDS) -> DataFrame:
    """(doc_id, text_class, class_id, kept) of every row.

    ``text_class`` is the smallest doc_id with the same text, ``class_id`` the
    smallest of the group linked by similarity >= ``similarity``, and ``kept``
    marks the document that stays. ``weights`` is "set" (every distinct shingle
    weighs one, plain Jaccard) or "count" (its occurrences). Texts without words
    (null ones count as empty) are equal to each other and near to nothing else.
    Rows that share a doc_id share a class if their texts are alike; a null
    doc_id is never a class id, and rows without any id stay, with a null
    class. An empty table gives an empty one.
    """
    signed = stored(sign(docs, weights, k, bands), "minhash-signed")
    classes = stored(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")).where("rep is not null"),
                     "minhash-classes")
    own = signed.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    rows = stored(own.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")), "minhash-bands")
    buckets = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    rows = stored(rows.join(buckets.select("key", "a"), "key").distinct(), "minhash-buckets")
    ids = stored(rows.select(F.col("id").alias("doc_id")).distinct(), "minhash-candidates")
    sketches = stored(of_ids(signed, ids, "doc_id")
                      .join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
                      .select(F.col("doc_id").alias("id"), "sketch").distinct(), "minhash-sketches")
    texts = of_ids(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id").dropDuplicates()
    sets = stored(weighted_sets(texts.select(F.col("doc_id").alias("id"), "text"), weights), "minhash-sets")
    pairs = rows.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = stored(alike(pairs, sketches, agreement(k, similarity)), "minhash-pairs")
    links = stored(similar(pairs, sets, similarity), "minhash-links")
    found = stored(connected_components(links), "minhash-components")
    named = (rows.join(found.withColumnRenamed("node", "id"), "id", "left")
             .select("key", "id", F.coalesce("component", "id").alias("component")))
    mixed = named.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("q")).where("x < y")
    mixed = mixed.groupBy("x", "y", "n", "p", "q").agg(F.min("key").alias("key"))    # equal buckets count once
    rest = named.join(mixed.select("key"), "key", "left_semi").join(sketches, "id")
    more = stored(across(rest, sets, k, similarity), "minhash-more")
    if not more.isEmpty():
        found = stored(connected_components(links.union(more)), "minhash-components")
    return (signed.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
            .join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("rep").alias("text_class"), F.coalesce("component", "rep").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())))
