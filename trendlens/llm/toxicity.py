"""Toxicity scores from class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the 7-grams of words' characters, one of toxic and
one of ordinary training texts; no gram reaches into the word before. Grams of four characters and more are counted per class; all shorter ones are
continuation counts of both classes together, so a rare expression backs off to
the same probability under both and says nothing. A gram's log ratio departs from that of the next shorter gram
only by what exceeds its standard error, so that a few texts of a class do not make
their ordinary words telling. A text is compared by its
log-likelihood ratio, normalised by its length and by the length's root, and over its
most toxic stretch; a logistic curve fitted on training rows the models have not seen
turns these into a score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, releasing, stored, with_hit

ORDER = 7                        # symbols; a gram is a 56-bit number
OWN = 4                          # shortest grams counted per class
DISCOUNT = 0.75
STRETCH = 24                     # symbols of the stretch
ERRORS = 2.0                     # standard errors taken off every log ratio
TELLING, FEW = 1.0, 20           # log ratio a word must exceed to tell; words added to every text
CURVE_SHARE = 5                  # one labelled row in so many is kept for the curve
MAX_GRAMS = 1 << 22              # grams and contexts of one broadcast; a larger model goes in parts
THRESHOLD = 0.3
GAP = " " * ORDER


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by a gap that keeps grams from reaching
    into the next, and where each starts. A symbol is a byte: a lower-cased
    character below 256, ASCII signs as spaces, others hashed to the upper half."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer((GAP + GAP.join(lower) + GAP).encode("utf-32-le"), np.uint32)
    data = np.where(points < 256, points, (points * np.uint32(2654435761) >> np.uint32(25)) + np.uint32(128))
    data = data.astype(np.uint8)
    sign = (data < 48) | (data > 57) & (data < 97) | (data > 122) & (data < 128)
    data[sign] = 32
    return data, np.cumsum([ORDER, *(len(t) + ORDER for t in lower)])[:-1]


def grams(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each symbol from the first gap's end on. Symbols before
    the word that holds (or ends before) the symbol are spaces."""
    n = len(data) - ORDER
    space = data == 32
    at = np.arange(len(data))
    before = np.maximum.accumulate(np.where(space, at, 0))      # last space up to each symbol
    start = np.append(0, before[:-1])                           # last space before each symbol
    key = np.zeros(n, np.int64)
    for k in range(1, ORDER + 1):
        key = key << 8 | np.where(at[k:k + n] > start[ORDER:], data[k:k + n], 32)
    return key


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """All labelled rows (held-out fold excluded) as (text, toxic, part); and how many
    labels each class has."""
    known = (labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), "toxic")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where((fold_of(F.col("doc_id")) != 2) & F.col("toxic").isin(0, 1)))
    known = stored(known.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE_SHARE)) == 0, "curve")
                                    .otherwise("model")), "toxicity-labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = likely(docs.select(F.col("doc_id").cast("long"), "text"), known).join(known, "doc_id")
    return stored(picked.select("text", "toxic", "part"), "toxicity-rows"), sizes


def likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` less most rows whose doc_id is not in ``known``, so that the join's shuffle
    does not move all texts; rows with a known id stay."""
    return with_hit(docs, "doc_id", known, "doc_id").where("hit").drop("hit")


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, t, o): occurrences in toxic and in ordinary rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                own = batch.column(0).filter(pc.equal(batch.column(1), y))
                for a, b in chunks(own, 1 << 21):
                    key, n = np.unique(grams(flat(own[a:b].to_pylist())[0]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n * y), pa.array(n * (1 - y))],
                                                     names=["gram", "t", "o"])

    return (rows.select("text", F.col("toxic").cast("int")).mapInArrow(releasing(run), "gram long, t long, o long")
            .groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(key, ratio): log p(toxic) - log p(ordinary) of every gram of ``OWN`` to
    ``ORDER`` symbols that was seen, and of the backoff weight after every context;
    ``tagged`` tells the keys apart. Shorter grams have one shared probability,
    which cancels. Entries without which ``ratios_of`` gives the same are left out:
    backoffs of 0, and grams with the next shorter one's ratio after such a context."""
    d, spread = F.lit(DISCOUNT), F.lit(0.0)

    def low(n):
        return F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))

    levels = {ORDER: counted}
    for n in range(ORDER - 1, OWN - 1, -1):             # a class's distinct left extensions
        levels[n] = stored(levels[n + 1].select(low(n).alias("gram"), "t", "o").groupBy("gram").agg(
            F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o")), "kn")
    for n in range(OWN - 1, 0, -1):                     # of both classes together
        levels[n] = stored(levels[n + 1].select(low(n).alias("gram")).groupBy("gram").agg(
            F.count("*").alias("c")), "kn")
    total = levels[1].agg(F.sum("c").alias("n"), F.count("*").alias("kinds")).first()
    p = levels[1].select("gram", (F.greatest(F.col("c") - d, spread) / max(1, total["n"] or 0)
                                  + d * total["kinds"] / max(1, total["n"] or 0) / 256).alias("p"))
    for n in range(2, OWN):
        level = levels[n].withColumn("context", F.shiftright("gram", 8))
        sums = level.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
        tail = p.select(F.col("gram").alias("tail"), F.col("p").alias("tail_p"))
        p = level.join(sums, "context").join(tail, low(n - 1) == F.col("tail")).select(
            "gram", ((F.greatest(F.col("c") - d, spread) + d * F.col("kinds") * F.col("tail_p"))
                     / F.col("n")).alias("p"))
    p = p.select("gram", F.col("p").alias("pt"), F.col("p").alias("po"), spread.alias("ratio"))
    found = None
    for n in range(OWN, ORDER + 1):
        level = levels[n].withColumn("context", F.shiftright("gram", 8))
        sums = level.groupBy("context").agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.count_if(
            F.col("t") > 0).alias("kt"), F.count_if(F.col("o") > 0).alias("ko"))
        after = {c: F.when(F.col("n" + c) > 0, d * F.col("k" + c) / F.col("n" + c)).otherwise(F.lit(1.0))
                 for c in "to"}
        own = {c: F.when(F.col("n" + c) > 0, F.greatest(F.col(c) - d, spread) / F.col("n" + c)).otherwise(spread)
               for c in "to"}
        tail = p.select(F.col("gram").alias("tail"), F.col("pt").alias("tail_t"), F.col("po").alias("tail_o"),
                        F.col("ratio").alias("tail_ratio"))
        p = stored(level.join(sums, "context").join(tail, low(n - 1) == F.col("tail")).select(
            "gram", *((own[c] + after[c] * F.col("tail_" + c)).alias("p" + c) for c in "to"),
            "t", "o", "tail_ratio", trusted(F.log(after["t"] / after["o"]), F.col("kt"), F.col("ko")).alias("back")
        ).withColumn("ratio", F.col("tail_ratio") + trusted(
                F.log(F.col("pt") / F.col("po")) - F.col("tail_ratio"), F.col("t"), F.col("o"))), "kn")
        both = p.where("ratio <> tail_ratio or back <> 0").select(tagged(F.col("gram"), n, 0).alias("key"), "ratio").union(
            sums.select(tagged(F.col("context"), n, 1).alias("key"), trusted(
                F.log(after["t"] / after["o"]), F.col("kt"), F.col("ko")).alias("ratio")).where("ratio <> 0"))
        found = both if found is None else found.union(both)
    return found


def trusted(ratio: Column, t: Column, o: Column) -> Column:
    """The part of a log ratio from ``t`` and ``o`` counts beyond its standard errors."""
    error = ERRORS * F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
    return F.signum(ratio) * F.greatest(F.abs(ratio) - error, F.lit(0.0))


def tagged(key, n: int, context: int):
    """Keys of one order and kind, in a range of their own."""
    return key + ((2 * n + context) << 8 * ORDER)


def part_of(middle, parts: int):
    """The part of the model for grams with these three symbols before the last one: a
    gram, its shorter forms and the contexts of all of them have the same."""
    return middle * 2654435761 % 16777213 % parts


def in_parts(ratios: DataFrame, most: int) -> list[DataFrame]:
    """The whole table, in as many parts as keep each at about ``most`` entries."""
    kept = stored(ratios, "kn-ratios")
    parts = max(1, -(-kept.count() // most))
    context = F.shiftright("key", 8 * ORDER).bitwiseAND(F.lit(1)) == 1
    middle = F.when(context, F.col("key")).otherwise(F.shiftright("key", 8)).bitwiseAND(F.lit(0xFFFFFF))
    return [kept.where(part_of(middle, parts) == k) for k in range(parts)]


def collected(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their ratios."""
    got = ratios.toArrow()
    keys, values = got.column("key").to_numpy(), got.column("ratio").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def look_up(model: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = model
    if not len(keys):
        return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], np.float32(0)), found


def ratios_of(model: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """Log ratio of each gram: its own where it was seen, else the backoff after its
    context and the ratio of the next shorter gram."""
    out = np.zeros(len(gram), np.float32)
    rest = np.arange(len(gram))
    for n in range(ORDER, OWN - 1, -1):
        short = gram[rest] & ((1 << 8 * n) - 1)
        value, found = look_up(model, tagged(short, n, 0))
        back = look_up(model, tagged(short[~found] >> 8, n, 1))[0]
        out[rest[found]] += value[found]
        rest = rest[~found]
        out[rest] += back
    return out


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram at each symbol of all texts, and where each text's begin and end."""
    data, starts = flat(texts)
    key = grams(data)
    starts = starts - ORDER
    return key, starts, np.append(starts[1:], len(key))


def add_ratios(docs: DataFrame, ratios: list[DataFrame]) -> DataFrame:
    """(doc_id, text, ratios): the log ratio of the gram at each symbol. Every part of
    the model is sent by itself and gives the ratios of its own grams."""
    parts = len(ratios)

    def filled(k, shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in chunks(batch.column(1)):
                    key, starts, ends = laid_out(batch.column(1)[a:b].to_pylist())
                    ratio = (np.frombuffer(b"".join(batch.column(2)[a:b].to_pylist()), np.float32).copy() if k
                             else np.zeros(len(key), np.float32))
                    own = np.flatnonzero(part_of(key >> 8 & 0xFFFFFF, parts) == k)
                    distinct, back = np.unique(key[own], return_inverse=True)
                    ratio[own] = ratios_of(shared.value, distinct)[back]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b], batch.column(1)[a:b],
                         pa.array([ratio[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())],
                        names=["doc_id", "text", "ratios"])
        return releasing(run)

    for k, part in enumerate(ratios):
        shared = docs.sparkSession.sparkContext.broadcast(collected(part))
        docs = stored(docs.mapInArrow(filled(k, shared), "doc_id long, text string, ratios binary"), "toxicity-ratios")
        shared.unpersist()
    return docs


def features(texts: list[str | None], model) -> np.ndarray:
    """``measures`` of texts by a whole model."""
    key, starts, ends = laid_out(texts)
    distinct, back = np.unique(key, return_inverse=True)
    return measures(key, starts, ends, ratios_of(model, distinct)[back])


def measures(key: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Per text, signed roots of: the mean log ratio a symbol, the sum over the root of
    the length, the mean in the highest stretch, and what words have beyond
    ``TELLING``, over the number of words and ``FEW`` more."""
    total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    size = ends - starts
    until = np.minimum(np.arange(len(key)) + STRETCH, np.repeat(ends, size))
    peak = np.maximum.reduceat(total[until] - total[:-1], starts) / STRETCH
    whole = total[ends] - total[starts]
    first = np.flatnonzero(np.append(True, (key[:-1] & 255) == 32))      # a word, or a lone space, begins
    word = np.append(first, len(key))
    telling = np.concatenate([[0.0], np.cumsum(np.maximum(0, np.diff(total[word]) - TELLING))])
    real = np.concatenate([[0], np.cumsum(np.diff(word) > 1)])
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    x = np.column_stack([whole / size, whole / np.sqrt(size), peak, (telling[b] - telling[a]) / (real[b] - real[a] + FEW)])
    return np.sign(x) * np.sqrt(np.abs(x))


def sums_of(known: DataFrame, part) -> list[np.ndarray]:
    """The sums over all rows (toxic, measures) of the arrays that ``part`` (y, x) gives a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = batch.column(0).to_numpy().astype(float), np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(p) for p in part(y, x)])], pa.list_(pa.float64()))],
                                             names=["sums"])
    shapes = [np.shape(p) for p in part(np.zeros(1), np.zeros((1, len(known.columns) - 1)))]
    total = np.zeros(sum(int(np.prod(s)) for s in shapes))
    for r in known.mapInArrow(run, "sums array<double>").toLocalIterator():    # a few numbers a batch of rows
        total += r["sums"]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [p.reshape(s) for p, s in zip(np.split(total, ends), shapes)]


def fit_curve(known: DataFrame, share: float, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression of rows (toxic, measures) by Newton steps on standardised
    measures, the classes weighted to ``share`` toxic rows: intercept and slopes for the
    measures as given. Every step adds up its gradient and curvature over all rows in Spark."""
    n, toxic, total = sums_of(known, lambda y, x: (np.float64(len(y)), y.sum(), x.sum(0)))
    middle = total / n
    spread = np.sqrt(sums_of(known, lambda y, x: (((x - middle) ** 2).sum(0),))[0] / n) + 1e-12
    own = np.array([(1 - share) / max(1.0, n - toxic), share / max(1.0, toxic)])
    own = own / ((n - toxic) * own[0] + toxic * own[1])
    w = np.zeros(len(middle) + 1)
    for _ in range(50):
        def part(y, x, w=w):
            a = np.column_stack([np.ones(len(x)), (x - middle) / spread])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            weight = own[y.astype(int)]
            return a.T @ (weight * (p - y)), (a * (weight * p * (1 - p))[:, None]).T @ a
        grad, hess = sums_of(known, part)
        step = np.linalg.solve(hess + ridge * np.eye(len(w)), grad + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / spread
    return np.concatenate([[w[0] - slopes @ middle], slopes])


def score_toxicity(docs: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS,
                   scored: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score): a score from 0 to 1 for every whole text.

    The classifier is fitted on all labelled rows outside the held-out fold, the
    models on four in five of them and the curve on the others; repeated labels of
    a document count as their maximum, null labels and ids not at all, and repeated
    documents as often as they come. Nothing but the text enters a score. Null and empty texts get the curve's value for an empty text. Without
    training rows of both classes every score is 0. An empty table gives an
    empty one; a null doc_id is not held out. ``scored``, if given, holds the
    (doc_id, text) rows to score in place of those of ``docs``, learned from alone.
    """
    spark = docs.sparkSession
    rows, sizes = training_rows(docs, labels)
    docs = docs if scored is None else scored
    have = {(r["part"], r["toxic"]) for r in rows.select("part", "toxic").distinct().collect()}
    held = F.coalesce(fold_of(F.col("doc_id").cast("long")) == 2, F.lit(False)).alias("held_out")
    if not {("model", 0), ("model", 1)} <= have:
        return docs.select(F.col("doc_id").cast("long"), held, F.lit(0.0).alias("score"))
    counted = stored(count_grams(rows.where("part = 'model'")), "kn-grams")
    ratios = in_parts(log_ratios(counted), max_grams)
    shared = spark.sparkContext.broadcast(collected(ratios[0])) if len(ratios) == 1 else None

    names = ["mean", "root", "peak", "telling"]

    def measured(curve):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in chunks(batch.column(1)):
                    texts = batch.column(1)[a:b].to_pylist()
                    if shared is not None:
                        x = features(texts, shared.value)
                    else:
                        x = measures(*laid_out(texts), np.frombuffer(b"".join(batch.column(2)[a:b].to_pylist()), np.float32))
                    if curve is not None:
                        x = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -700, 700)))[:, None]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c) for c in x.T.copy())],
                                                     names=["doc_id", *(names if curve is None else ["score"])])
        return releasing(run)

    def ready(df: DataFrame) -> DataFrame:
        return df if shared is not None else add_ratios(df, ratios)

    part = "curve" if {("curve", 0), ("curve", 1)} <= have else "model"
    known = stored(ready(rows.where(F.col("part") == part).select(F.col("toxic").cast("long").alias("doc_id"), "text"))
                   .mapInArrow(measured(None), "doc_id long, mean double, root double, peak double, telling double"), "toxicity-curve")
    curve = fit_curve(known, sizes[1] / (sizes[0] + sizes[1]))
    scored = ready(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        measured(curve), "doc_id long, score double")
    return scored.select("doc_id", held, "score")


def judged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

