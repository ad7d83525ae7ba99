"""Hard negatives by Fagin's threshold algorithm.

Rows are cut into blocks. Within a block every dimension has a list of the rows sorted
by that component; an anchor walks the lists of its positive components from the top and
those of its negative components from the bottom, all at once, and scores every row it
meets by the whole integer inner product. A row not met by depth p scores at most the
threshold, the inner product of the anchor with the components standing at depth p. The
walk ends once the threshold is strictly below the kth score of every window the anchor
searches (an equal score could still win by its smaller id), or below the window.

Two walks: over rows of the anchor's label for its positives, then over the others with
one window a distinct positive score. Each block gives at most k rows a window, and
Spark ranks what the blocks found. Anchors are cut into blocks too, so a task holds one
block of each.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_small
from .common import prepare, stored
from .fixedpoint import LONG, finite_vectors, floors, held_in_long, matrix

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST, MOST, WHOLE = 80, 100, 100     # a negative's score in hundredths of the positive's
ROW_BLOCK, ANCHOR_BLOCK = 4096, 1024
FIRST_DEPTH = 32
EXACT = float(1 << 52)                # inner products below this are exact in double


class Lists:
    """The rows of one block (or of one of its labels) by every dimension's component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        if x.shape[1]:
            self.order = np.argsort(-x, axis=0, kind="stable").astype(np.int32).T       # dimension by place
            self.values = np.take_along_axis(x, self.order.T.astype(np.int64), 0).T

    def walk(self, anchor: np.ndarray, clip, enough):
        """Scores rows by the threshold algorithm until ``enough(rows, scores, threshold)``."""
        x, n = self.x, len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):                       # every row scores 0, and no list is walked
            rows = np.arange(n)
            return rows, clip(x @ anchor)
        met = np.zeros(n, bool)
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, x.dtype)]
        at, depth = 0, FIRST_DEPTH
        while at < n:
            to = min(n, depth)
            new = np.zeros(n, bool)
            new[self.order[up, at:to].ravel()] = True
            new[self.order[down, n - to:n - at].ravel()] = True
            new &= ~met
            met |= new
            found = np.flatnonzero(new)
            rows.append(found)
            scores.append(clip(x[found] @ anchor))
            if to == n or met.all():
                break
            threshold = clip(np.array([self.values[up, to - 1] @ anchor[up] + self.values[down, n - to] @ anchor[down]]))[0]
            if enough(np.concatenate(rows), np.concatenate(scores), threshold):
                break
            at, depth = to, depth * 2
        return np.concatenate(rows), np.concatenate(scores)


def numbers(vectors: np.ndarray, anchors: np.ndarray, scale: int):
    """Rows and anchors as whole numbers, in double where all their inner products are
    exact so, else as Python integers; and how scores beyond a long are held at its ends."""
    x, a = floors(vectors, scale, 1 << 26), floors(anchors, scale, 1 << 26)
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    if most(x) * most(a) * max(1, x.shape[1]) < EXACT:
        return x.astype(np.float64), a.astype(np.float64), lambda s: s
    hold = lambda s: np.array([*held_in_long(s), None], object)[:-1]
    return x.astype(object), a.astype(object), hold


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones in the order they stand in."""
    return np.argsort(-scores, kind="stable")[:k]


def kth(scores: np.ndarray, k: int):
    return np.sort(scores)[-k] if len(scores) >= k else None


def positives_of(anchor, own: int, lists: Lists, clip, k: int):
    """(places, scores) of the first k rows but the anchor's own."""
    def enough(rows, scores, threshold):
        least = kth(scores[rows != own], k)
        return least is not None and threshold < least
    rows, scores = lists.walk(anchor, clip, enough)
    order = np.argsort(rows)                             # places follow the ids
    rows, scores = rows[order], scores[order]
    rows, scores = rows[rows != own], scores[rows != own]
    top = best(scores, k)
    return rows[top], scores[top]


def negatives_of(anchor, other: np.ndarray, windows: list[int], lists: Lists, clip, k: int):
    """(window, places, scores): of the rows marked in ``other``, the first k within each
    window of scores [LEAST / 100 of it, it]."""
    bounds = [(w, -(-LEAST * w // WHOLE), w * MOST // WHOLE) for w in windows if LEAST * w <= MOST * w]
    if not bounds:
        return []

    def within(rows, scores, low, high):
        return other[rows] & (scores >= low) & (scores <= high)

    def enough(rows, scores, threshold):
        for _, low, high in bounds:
            least = kth(scores[within(rows, scores, low, high)], k)
            if threshold >= (low if least is None else least):
                return False
        return True
    rows, scores = lists.walk(anchor, clip, enough)
    order = np.argsort(rows)
    rows, scores = rows[order], scores[order]
    out = []
    for w, low, high in bounds:
        inside = np.flatnonzero(within(rows, scores, low, high))
        top = inside[best(scores[inside], k)]
        out.append((w, rows[top], scores[top]))
    return out


FOUND = "anchor long, wanted long, row long, vec_id long, score long"


def finder(scale: int, k: int, windows: bool):
    """Compares a block of anchors with a block of rows; gives at most k rows an anchor
    (its positives) or a window of it (its negatives)."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "wanted": [], "row": [], "vec_id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            ids = rows.column("vec_id")
            rows = rows.take(pa.array(np.lexsort((rows.column("row").to_numpy(), ids.fill_null(LONG).to_numpy(),
                                                  ids.is_null().to_numpy()))))
            row, ids = rows.column("row").to_numpy(), rows.column("vec_id").to_pylist()
            x, a, clip = numbers(matrix(rows.column("v").combine_chunks(), dim),
                                 matrix(anchors.column("a_v").combine_chunks(), dim), scale)
            label, of = rows.column("label").to_numpy(), anchors.column("a_label").to_numpy()
            a_row = anchors.column("a_row").to_numpy()

            def put(anchor, wanted, places, scores):
                for p, s in zip(places.tolist(), held_in_long(scores)):
                    for c, value in zip(out, (anchor, wanted, int(row[p]), ids[p], s)):
                        out[c].append(value)
            if windows:
                lists = Lists(x)
                for i, wanted in enumerate(anchors.column("wanted").to_pylist()):
                    for w, places, scores in negatives_of(a[i], label != of[i], wanted, lists, clip, k):
                        put(int(a_row[i]), w, places, scores)
            else:
                by_label = np.argsort(label, kind="stable")            # rows of a label keep their places
                of_rows = label[by_label]
                for value in np.unique(of):
                    member = by_label[np.searchsorted(of_rows, value):np.searchsorted(of_rows, value, "right")]
                    lists = Lists(x[member])
                    for i in np.flatnonzero(of == value).tolist():
                        own = np.flatnonzero(row[member] == a_row[i])
                        places, scores = positives_of(a[i], int(own[0]) if len(own) else -1, lists, clip, k)
                        put(int(a_row[i]), None, member[places], scores)
        return pa.table([pa.array(c, pa.int64()) for c in out.values()], names=list(out))
    return run


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * component). ``is_anchor`` is a condition on vec_id. An
    anchor's positives are the ``positives`` other rows of its label with the highest inner
    products; for each come the ``negatives`` highest rows of other labels that score
    between LEAST and MOST hundredths of it. Equal scores follow vec_id, null ids last.

    Rows without label or vector, or with a null or non-finite component, take no part.
    Repeated ids are rows of their own: each is another row of the other, and an anchor for
    itself. Vectors of another length than the anchor's are not compared with it. Scores
    are exact; those beyond a long are held, and compared, at its ends. A positive whose
    window is empty (as below zero) has no row. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("embedding").cast("array<double>")
    rows = stored(vectors.where(F.col("label").isNotNull() & finite_vectors(vectors, "embedding")).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), F.size(v).alias("dim"), v.alias("v")), "negatives-rows")
    chosen = F.coalesce(is_anchor, F.lit(False))
    blocks = stored(rows.groupBy("dim").agg(
        F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks"),
        F.ceil(F.sum(chosen.cast("long")) / ANCHOR_BLOCK).cast("int").alias("anchor_blocks")).where("anchor_blocks > 0"),
        "negatives-blocks")

    def dealt(df: DataFrame, key: str, own: str, others: str) -> DataFrame:
        """Every row with its own block, once for each block of the other side."""
        return (df.join(broadcast_small(blocks, 100_000), "dim")
                .withColumn(own, F.pmod(F.xxhash64(key, F.lit(own)), F.col(own + "_blocks")).cast("int"))
                .withColumn(others, F.explode(F.sequence(F.lit(0), F.col(others + "_blocks") - 1))))

    keys = ["dim", "anchor", "row_block"]
    stock = dealt(rows.withColumnRenamed("row", "id"), "id", "row", "anchor").select(
        "dim", "anchor", F.col("row").alias("row_block"), F.col("id").alias("row"), "vec_id", "label", "v")
    anchors = rows.where(chosen).select("dim", F.col("row").alias("a_row"), F.col("label").alias("a_label"), F.col("v").alias("a_v"))

    def found(searching: DataFrame, k: int, windows: bool) -> DataFrame:
        sent = dealt(searching, "a_row", "anchor", "row").withColumnRenamed("row", "row_block").drop(
            "row_blocks", "anchor_blocks")
        sent = sent.select(*(F.col(c).alias("k_" + c) for c in keys), *(c for c in sent.columns if c not in keys))
        pairs = sent.groupBy(*("k_" + c for c in keys)).cogroup(stock.groupBy(*keys)).applyInArrow(finder(scale, k, windows), FOUND)
        order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best_ = stored(found(anchors, positives, False).select(
        F.col("anchor").alias("a_row"), F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"),
        F.col("score").alias("positive_score")), "negatives-positives")
    wanted = best_.groupBy("a_row").agg(F.collect_set("positive_score").alias("wanted"))
    worst = found(anchors.join(wanted, "a_row"), negatives, True).select(
        F.col("anchor").alias("a_row"), F.col("wanted").alias("positive_score"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"), "rank")
    names = rows.where(chosen).select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    return best_.join(worst, ["a_row", "positive_score"]).join(names, "a_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
