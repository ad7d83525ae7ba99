"""Near-duplicate vectors by product quantisation.

Unit vectors are assigned to coarse inverted lists; the residual to the list's
centre is coded per subspace. A query visits every list that can hold a vector within
the link distance, and its nearest ones at least. It estimates distances by asymmetric
table lookup, and every vector whose estimate is within the link distance plus that
vector's own coding error (stored with the code, so the estimate drops no link) is
compared by exact cosine.

Equal vectors form one class first and travel once, with their number. Small lists
share a bin, which a query is sent to once. Bins are cut into blocks and their
visitors too, so a dense list is spread over many tasks; a task returns link counts
and a spanning forest, never all its pairs. Of two bins only the vectors of the first
visit the other, and a link found there counts for both its ends.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

COSINE = 0.9
SAMPLE = 20_000              # vectors the index is fitted on, at most
LISTS = 4096                 # coarse lists, at most
SUBSPACES, CODES = 16, 256
PROBES = 16                  # lists a query visits, at least
APART = 0.5                  # centres nearer to each other are merged: a dense group is one list
LIST_BLOCK, QUERY_BLOCK = 4096, 4096


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)[0]
        sums, n = np.zeros_like(c), np.bincount(a, minlength=len(c))
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(x, c)
    a = d.argmin(1)
    return a, d[np.arange(len(x)), a]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


class Model:
    """Coarse centres and the codebooks of the residual's subspaces."""

    def __init__(self, sample: np.ndarray, rows: int):
        lists = max(1, min(LISTS, int(rows ** 0.5)))
        centres = k_means(sample, lists, 10, 0)
        kept: list[int] = []
        for i in range(len(centres)):
            if not kept or squared(centres[i:i + 1], centres[kept]).min() >= APART ** 2:
                kept.append(i)
        self.centres = centres[kept]
        residual = sample - self.centres[nearest(sample, self.centres)[0]]
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], CODES, 8, 1) for a, b in zip(self.cuts, self.cuts[1:])]

    def visits(self, x: np.ndarray, own: np.ndarray, radius: float, probes: int) -> np.ndarray:
        """Vectors by lists: which lists may hold a vector within ``radius``, given the
        vectors' own lists. A member is no nearer to another centre than to its own, and
        the difference of the squares of these distances changes by at most
        2 * radius * (distance of the centres) on the way."""
        d = squared(x, self.centres)
        apart = np.sqrt(squared(self.centres[own], self.centres))
        to = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * apart
        if probes < d.shape[1]:
            to[np.arange(len(x))[:, None], np.argpartition(d, probes - 1, axis=1)[:, :probes]] = True
        else:
            to[:] = True
        return to

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the error each is coded with."""
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        error = np.zeros(len(residual))
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            codes[:, k], e = nearest(residual[:, a:b], book)
            error += e
        return codes, np.sqrt(error)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Per subspace, entries by queries: -2 * (query . entry). What else a squared
        distance to a coded vector consists of depends on the query and the list, or on
        the list and the code, so the tables hold for every list."""
        return [(book @ (-2 * x[:, a:b].T)).astype(np.float32)
                for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def constants(self, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Per coded vector |r|^2 + 2 (centre . r), r its residual as coded."""
        out = np.zeros(len(codes))
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            r = book[codes[:, k]]
            out += (r * (r + 2 * self.centres[of, a:b])).sum(1)
        return out

    def estimates(self, tables: list[np.ndarray], start: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances, coded vectors by queries: ``start`` (|query - centre|^2
        and the constants) and a table entry per subspace. A row of a table holds an entry
        for all queries, so look-ups copy rows."""
        out = start.astype(np.float32)
        row = np.empty_like(out)
        for k, table in enumerate(tables):
            out += np.take(table, codes[:, k], axis=0, out=row, mode="clip")
        return out


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def bins_of(centres: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The bin of each list: lists that follow each other along the centres' main
    direction share one of about ``LIST_BLOCK`` vectors."""
    middle = centres - centres.mean(0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    out = np.empty(len(centres), np.int64)
    bin_, size = 0, 0
    for k in order.tolist():
        if size and size + held[k] > LIST_BLOCK:
            bin_, size = bin_ + 1, 0
        out[k] = bin_
        size += held[k]
    return out


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable, over edges among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(vectors: DataFrame) -> DataFrame:
    """(rep, n, vector, dim): classes of equal vectors without null, zero or
    non-finite components only; rep is the smallest vec_id."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).select(
        "vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))        # no negative zeros


def link(vectors: DataFrame, least: float = COSINE, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(classes, found): classes (vec_id, rep, n) of equal vectors, and per class
    representative n_links and component."""
    good = usable(vectors)
    spark = vectors.sparkSession
    classes = stored(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
                     .withColumn("dim", F.size("v")).where("rep is not null"), "pq-classes")
    links = []
    lengths = classes.groupBy("dim").agg(F.count("*").alias("rows"))
    alone = classes.join(lengths.where("rows = 1").select("dim"), "dim", "left_semi")  # copies of one vector
    links.append(alone.select(F.lit(0).alias("kind"), F.col("rep").alias("a"), F.col("n").alias("b")))
    for row in lengths.where("rows > 1").collect():                                   # one row a dimension
        links.append(_link_dimension(classes.where(F.col("dim") == row["dim"]), row["dim"], row["rows"], least, probes))
    empty = spark.createDataFrame([], "kind int, a long, b long")
    found = empty
    for x in links:
        found = found.union(x)
    found = stored(found, "pq-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg((F.sum("b") - 1).alias("n_links"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    per_class = counts.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "n_links", F.coalesce("component", "rep").alias("component"))
    named = good.join(classes.select("v", "rep"), "v").select("vec_id", "rep")
    return named, per_class


def _link_dimension(classes: DataFrame, dim: int, rows: int, least: float, probes: int) -> DataFrame:
    """(kind, a, b): kind 0 link counts b of class a, kind 1 edges of spanning forests."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
    x = vectors_of(sample.column(0).combine_chunks(), dim)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    model = Model(x / np.linalg.norm(x, axis=1, keepdims=True), rows)
    shared = spark.sparkContext.broadcast(model)         # LISTS + CODES centres at most

    def assign(batches):
        m = shared.value
        for batch in batches:
            v = vectors_of(batch.column(1), dim)
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            own = nearest(v, m.centres)[0]
            codes, error = m.code(v - m.centres[own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in v], pa.binary()),
                 pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error), pa.array(own)],
                names=["rep", "n", "unit", "codes", "error", "list"])

    rows_ = stored(classes.select("rep", "v", "n").mapInArrow(
        assign, "rep long, n long, unit binary, codes binary, error double, list long"), "pq-index")
    held = np.zeros(len(model.centres), np.int64)
    for r in rows_.groupBy("list").count().collect():                                 # LISTS rows at most
        held[r["list"]] = r["count"]
    bins = bins_of(model.centres, held)
    radius = (2 - 2 * least) ** 0.5 + 1e-4

    def visit(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, dim)
                to = m.visits(x, part.column(2).to_numpy(), radius, probes)
                query, to = np.nonzero(to)
                later = bins[to] >= bins[part.column(2).to_numpy()[query]]      # the other way round: the other visits
                query, to = np.unique(np.column_stack([query[later], bins[to[later]]]), axis=0).T
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(query)) for c in part.columns), pa.array(to)],
                                                 names=["rep", "unit", "own", "n", "bin"])

    of_list = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bins)], "list long, bin long")
    rows_ = rows_.join(F.broadcast(of_list), "list")                                  # LISTS rows at most
    visitors = stored(rows_.select("rep", "unit", "list", "n").mapInArrow(
        visit, "rep long, unit binary, own long, n long, bin long"), "pq-visits")
    size = F.broadcast(stored(
        visitors.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
        .join(rows_.groupBy("bin").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("list_blocks")), "bin"),
        "pq-bins"))                                                                   # LISTS rows at most

    def block(n, salt):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")

    stock = (rows_.join(size, "bin").withColumn("i", block("list_blocks", 1))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
             .select("bin", "i", "j", "rep", "n", "unit", "codes", "error", "list"))
    queries = (visitors.join(size, "bin").withColumn("j", block("query_blocks", 2))
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("list_blocks") - 1)))
               .select(*(F.col(c).alias("q_" + c) for c in ("bin", "i", "j", "rep", "unit", "own", "n"))))

    def compare(q: pa.Table, s: pa.Table) -> pa.Table:
        kind, a, b = [], [], []
        if q.num_rows and s.num_rows:
            m = shared.value
            unit = lambda c: np.frombuffer(b"".join(c.to_pylist())).reshape(-1, dim)
            qu, su = unit(q.column("q_unit")), unit(s.column("unit"))
            codes = np.frombuffer(b"".join(s.column("codes").to_pylist()), np.uint8).reshape(len(su), -1)
            error, n = s.column("error").to_numpy(), s.column("n").to_numpy()
            ids = np.concatenate([q.column("q_rep").to_numpy(), s.column("rep").to_numpy()])
            own, of = q.column("q_own").to_numpy(), s.column("list").to_numpy()
            lists = [(k, member[a:a + 512]) for k in np.unique(of) for member in [np.flatnonzero(of == k)]
                     for a in range(0, len(member), 512)]
            fixed, bound = m.constants(codes, of), ((radius + error + 1e-4) ** 2).astype(np.float32)
            x, y = [], []
            for at in range(0, len(qu), 256):
                block = qu[at:at + 256]
                to = m.visits(block, own[at:at + 256], radius, probes)
                far, tables = squared(block, m.centres), m.tables(block)
                for k, member in lists:
                    query = np.flatnonzero(to[:, k])
                    if not len(query):
                        continue
                    mine = tables if len(query) == len(block) else [np.take(t, query, axis=1) for t in tables]
                    start = fixed[member][:, None] + far[query, k][None, :]
                    j, i = np.nonzero(m.estimates(mine, start, codes[member]) <= bound[member][:, None])
                    i, j = query[i] + at, member[j]
                    real = (qu[i] * su[j]).sum(1) >= least
                    x.append(i[real])
                    y.append(j[real])
            x, y = np.concatenate(x), np.concatenate(y)
            # a query of another bin is not visited in turn, so its links count for both here
            theirs = bins[own[x]] != s.column("bin")[0].as_py()
            hit = np.concatenate([np.bincount(x, n[y], len(qu)), np.bincount(
                y[theirs], q.column("q_n").to_numpy()[x[theirs]], len(su))]).astype(np.int64)
            seen = np.flatnonzero(hit)
            # the two sides may name one vector twice: nodes are class ids
            node, where = np.unique(ids, return_inverse=True)
            label = components(where[x], where[len(qu) + y], len(node))
            joined = np.flatnonzero(label != np.arange(len(node)))
            kind = np.concatenate([np.zeros(len(seen), np.int32), np.ones(len(joined), np.int32)])
            a = np.concatenate([ids[seen], node[joined]])
            b = np.concatenate([hit[seen], node[label[joined]]])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["bin", "i", "j"]
    return queries.groupBy(*("q_" + k for k in keys)).cogroup(stock.groupBy(*keys)).applyInArrow(compare, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = COSINE, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine >= ``least`` in
    double precision.

    Null vectors, zero vectors, those with null or non-finite components and
    vectors of another length link with nothing. Rows that repeat a vec_id
    are rows of their own, and count as links of each other if their vectors do.
    A row with a null vec_id has the component of its links, and keeps itself
    only if there is none. An empty table gives an empty one.
    """
    named, per_class = link(vectors, least, probes)
    joined = named.join(per_class, "rep").groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long"))
    out = (ids.join(joined.withColumnRenamed("vec_id", "id"), F.col("vec_id").eqNullSafe(F.col("id")), "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
