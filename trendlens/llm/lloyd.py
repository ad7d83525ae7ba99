"""Vector codes by Lloyd's method over subspaces, with active entries.

A vector of whole numbers is cut into consecutive parts; each part position has a
codebook, and a part is coded by its nearest entry. Between two rounds most entries come
to rest, so a part keeps the exact distance to the entry it is assigned to: while that
entry stays where it is, no entry at rest can beat it, and only the entries that moved
are compared with the stored distance. Parts whose own entry moved are compared with
the whole codebook. Equal distances go to the lower index either way, so the codes are
those of a full search.

A round is one pass: tasks read the rows with their codes and distances, write them
anew, and add up their parts by entry; Spark merges these sums, one row an entry and
task, and the codebooks (parts x entries, whatever the number of rows) go out again.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_small
from .common import prepare, stored, tasks_for
from .fixedpoint import LONG, finite_vectors, floors, held_in_long, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SLICE = 8192                  # rows that a task works on at once
UNKNOWN = -1                  # no stored distance: the part is compared with all entries

STATE = "vec_id long, label string, dim int, v array<double>, codes binary, distances binary"
SUMS = "array<struct<dim:int,part:int,entry:int,n:long,total:array<string>>>"


def cuts_of(dim: int, parts: int) -> list[int]:
    return [dim * k // parts for k in range(parts + 1)]


def safe_size(width: int) -> int:
    """Whole numbers below this have squared distances over ``width`` components, and
    sums over ``SLICE`` rows, within a long."""
    return int((2 ** 61 / max(1, width)) ** 0.5) // 2


def distances_to(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, rows by entries; exact whole numbers."""
    out = [((x - e) ** 2).sum(1) for e in book]
    return np.stack(out, axis=1) if len(x) else np.zeros((0, len(book)), np.int64)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries and exact distances of the rows ``x`` of one part, and how many
    distances were computed. ``code`` and ``distance`` are those of the round before;
    ``moved`` says which entries are elsewhere since then."""
    code, distance = code.astype(np.int64), distance.astype(x.dtype)
    full = distance < 0
    full[~full] = moved[code[~full]]
    work = 0
    if full.any():
        d = distances_to(x[full], book)
        best = d.argmin(1)                               # the lowest index of equal ones
        code[full], distance[full] = best, d[np.arange(len(d)), best]
        work += d.size
    rest = np.flatnonzero(~full)
    active = np.flatnonzero(moved)
    if len(rest) and len(active):
        d = distances_to(x[rest], book[active])
        best = d.argmin(1)
        near, entry = d[np.arange(len(d)), best], active[best]
        better = (near < distance[rest]) | ((near == distance[rest]) & (entry < code[rest]))
        code[rest[better]], distance[rest[better]] = entry[better], near[better]
        work += d.size
    return code, distance, work


def entry_sums(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and componentwise sums of each entry."""
    total = np.zeros((entries, x.shape[1]), x.dtype)
    for e in np.unique(code).tolist():
        total[e] = x[code == e].sum(0)
    return np.bincount(code, minlength=entries), total


class Books:
    """The codebooks of every vector length: {dim: [entries x components of a part]}."""

    def __init__(self, books: dict[int, list[np.ndarray]]):
        self.books = books
        self.moved = {dim: [np.ones(len(b), bool) for b in own] for dim, own in books.items()}

    def replaced(self, sums: dict[tuple[int, int, int], tuple[int, list[int]]]) -> "Books":
        """Every used entry becomes floor(sum / count) of its parts; others stay."""
        new = {dim: [b.copy() for b in own] for dim, own in self.books.items()}
        for (dim, part, entry), (n, total) in sums.items():
            values = [t // n for t in total]
            if new[dim][part].dtype != object and any(abs(v) >= safe_size(len(values)) for v in values):
                new[dim][part] = new[dim][part].astype(object)
            new[dim][part][entry] = values
        out = Books(new)
        out.moved = {dim: [(a != b).any(1) if a.shape[1] else np.zeros(len(a), bool) for a, b in zip(own, self.books[dim])]
                     for dim, own in new.items()}
        return out

    def digest(self, dim: int) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books[dim] for e in b for v in e).encode()).hexdigest()


def encoder(shared, scale: int, parts: int, last: bool):
    """One pass over the rows: new codes and distances, and the sums by entry of the task."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("v", pa.list_(pa.float64())),
                        ("codes", pa.binary()), ("distances", pa.binary()), ("error", pa.int64()),
                        ("sums", pa.list_(pa.struct([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()),
                                                     ("n", pa.int64()), ("total", pa.list_(pa.string()))])))])

    def run(batches):
        state = shared.value
        gathered: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                dims = rows.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = rows.filter(pa.array(dims == dim))
                    yield pa.RecordBatch.from_arrays(coded(own, dim, state, gathered), schema=schema)
        if not last:
            sums = [{"dim": d, "part": p, "entry": e, "n": n, "total": [str(t) for t in total]}
                    for (d, p, e), (n, total) in gathered.items()]
            yield pa.RecordBatch.from_pylist([{"sums": sums}], schema)

    def coded(rows, dim, state, gathered):
        n, cuts = rows.num_rows, cuts_of(dim, parts)
        x = floors(matrix(rows.column(3), dim), scale, safe_size(-(-dim // parts)))
        codes = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(n, parts).copy()
        stored_ = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.int64).reshape(n, parts).copy()
        error = np.zeros(n, x.dtype)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            book, part = state.books[dim][k], x[:, a:b]
            if book.dtype == object:
                part = part.astype(object)
            code, distance, _ = assign(part, book, state.moved[dim][k], codes[:, k], stored_[:, k])
            codes[:, k] = code
            error = error + distance
            stored_[:, k] = distance if distance.dtype != object else [d if d <= LONG else UNKNOWN for d in distance]
            if not last:
                many, total = entry_sums(part, code, len(book))
                for e in np.flatnonzero(many).tolist():
                    m, t = gathered.get((dim, k, e), (0, [0] * (b - a)))
                    gathered[dim, k, e] = (m + int(many[e]), [u + int(v) for u, v in zip(t, total[e])])
        return [*rows.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array([d.tobytes() for d in stored_], pa.binary()), pa.array(held_in_long(error), pa.int64()),
                pa.nulls(n, schema.field("sums").type)]
    return run


def merged_sums(passed: DataFrame) -> dict[tuple[int, int, int], tuple[int, list[int]]]:
    """The sums of all tasks by entry: parts x entries rows a vector length."""
    def merge(key, table):
        total = [0] * len(table.column("total")[0])
        for t in table.column("total").to_pylist():
            total = [a + int(b) for a, b in zip(total, t)]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "entry": pa.array([key[2].as_py()], pa.int32()),
                         "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "total": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    rows = passed.where("sums is not null").select(F.explode("sums").alias("s")).select("s.*")
    merged = rows.groupBy("dim", "part", "entry").applyInArrow(
        merge, "dim int, part int, entry int, n long, total array<string>")
    return {(r["dim"], r["part"], r["entry"]): (r["n"], [int(t) for t in r["total"]]) for r in merged.collect()}


def first_books(rows: DataFrame, scale: int, parts: int, entries: int) -> Books:
    """Codebooks of the parts of the smallest ids, for every vector length there is."""
    books = {}
    for dim in sorted(r["dim"] for r in rows.groupBy("dim").count().collect()):       # one row a length
        own = rows.where(F.col("dim") == dim)
        top = own.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        x = floors(np.array([r["v"] for r in top], np.float64).reshape(len(top), dim), scale, safe_size(-(-dim // parts)))
        cuts = cuts_of(dim, parts)
        books[dim] = [x[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    return Books(books)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(coded, books): coded (vec_id, label, dim, codes, error) has a row for every vector
    that is there and holds no null or non-finite component; ``error`` is its squared
    distance to its entries, in units of 1 / scale. Books are the final codebooks.

    Repeated ids are rows of their own; a null id counts as the largest. Rows with equal
    ids start the codebooks in the order of their vectors. Vectors of each length have
    codebooks of their own, cut as evenly as can be (an empty part has code 0). With fewer
    vectors than entries a codebook has one entry a vector. Components of any size are
    exact; an error beyond a long is given as the largest long. Labels are compared as
    text; other columns are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    prepare(spark)
    if entries > 256:
        raise ValueError("an entry's index has one byte")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(finite_vectors(vectors, "embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.size(v).alias("dim"), v.alias("v"),
        F.lit(bytes(parts)).alias("codes"), F.lit(np.full(parts, UNKNOWN, "<i8").tobytes()).alias("distances"))
    rows = stored(rows, "lloyd-vectors")
    books = first_books(rows, scale, parts, entries)
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)       # parts x entries x components a length
        passed = rows.mapInArrow(encoder(shared, scale, parts, last=k == rounds), f"{STATE}, error long, sums {SUMS}")
        passed = passed.checkpoint(eager=True)
        rows = passed.where("sums is null").drop("error", "sums")
        if k < rounds:
            books = books.replaced(merged_sums(passed))
    return passed.select("vec_id", "label", "dim", "codes", "error"), books


def digests(coded: DataFrame, books: Books) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256. An error summed over equal
    labels (null is one of them) beyond a long is given as the largest long."""
    spark = coded.sparkSession
    by_label = stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(
        F.col("label").alias("of"), F.least("sum", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")),
        "lloyd-labels")
    shas = spark.createDataFrame([(d, books.digest(d)) for d in books.books], "dim int, codebooks_sha256 string")
    return (coded.join(broadcast_small(by_label, 10 * tasks_for(spark) + 1000), F.col("label").eqNullSafe(F.col("of")))
            .join(F.broadcast(shas), "dim")                                            # one row a length
            .select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256"))
