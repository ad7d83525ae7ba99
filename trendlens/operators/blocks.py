"""Products of a sparse document-term matrix with dense matrices of bounded size.

Documents are packed into blocks of a few rows: entries a row, term numbers and values, or
in place of the values the occurrences, of which and the idf a task makes them again. A
block meets its dense row (its part of W) by block number, so the blocks are dealt and
sorted once, stay where they are, and only the dense rows move. No entry is ever keyed by
its term, so a term that occurs in most documents is no hot key.

The dense matrix over the terms (terms x columns) goes out in term blocks of at most
``BROADCAST_BYTES``; with more than one, a pass is a chain of steps, each holding one.
Products with the transpose are added up inside every task and leave it as one row a
chunk of terms; Spark merges them in a tree, ``FAN_IN`` rows at a time. They are as many as
the tasks, so a pass has no more tasks than the cluster has cores. What a pass gives is
written to the shared folder; the pass before is removed then.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS, drop_table, ensure_checkpoint_dir, ship_package, text_partitions, write_table

BLOCK_DOCS = 128
BROADCAST_BYTES = 64 << 20
CHUNK_BYTES = 1 << 18
FAN_IN = 64
SLICE = 64                     # blocks that a step has in Python at once
GRAM = -1                      # the chunk that holds left' left

MATRIX = "many binary, idx binary, val binary"
_MATRIX = [("many", pa.binary()), ("idx", pa.binary()), ("val", pa.binary())]
PACKED = f"block long, ids array<{{}}>, {MATRIX}, start binary, squares double"
STATE = "block long, dense binary, chunk int, part binary"
_STATE = pa.schema([("block", pa.int64()), ("dense", pa.binary()), ("chunk", pa.int32()), ("part", pa.binary())])


def segment_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by key; ``keys`` are sorted."""
    if not len(keys):
        return keys, values
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(values, starts, axis=0)


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def matrix_row(number: int, ids: pa.Array, many: np.ndarray, idx: np.ndarray, val: np.ndarray, squares: float,
               start: np.ndarray | None = None) -> pa.RecordBatch:
    """A row of PACKED; ``val`` are values or, whole numbers, occurrences."""
    held = narrow(val) if val.dtype.kind in "iu" else val.tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
         *(pa.array([x], pa.binary()) for x in (narrow(many), narrow(idx), held, None if start is None else start.tobytes())),
         pa.array([squares], pa.float64())], names=["block", "ids", *(c for c, _ in _MATRIX), "start", "squares"])


class Sparse:
    """One block of documents; with ``idf`` its values are tf * idf in rows of unit length."""

    def __init__(self, many: bytes, idx: bytes, val: bytes, idf: np.ndarray | None = None):
        entries, self.idx = wide(many), wide(idx)
        self.n = len(entries)
        self.row = np.repeat(np.arange(self.n), entries)
        if idf is None:
            self.val = np.frombuffer(val, np.float64)
        else:
            w = wide(val) * idf[self.idx]
            self.val = w / np.sqrt(np.bincount(self.row, w * w, minlength=self.n))[self.row]
        self.by_term = np.argsort(self.idx.astype(np.min_scalar_type(int(self.idx.max(initial=0)))), kind="stable")

    def add_times(self, out: np.ndarray, m: np.ndarray, low: int) -> None:
        """out += X[:, low:low + len(m)] . m"""
        at = slice(None) if low == 0 and (not len(self.idx) or self.idx[self.by_term[-1]] < len(m)) else np.flatnonzero(
            (self.idx >= low) & (self.idx < low + len(m)))
        rows, sums = segment_sums(self.row[at], m[self.idx[at] - low] * self.val[at, None])
        out[rows] += sums

    def add_transposed(self, out: np.ndarray, y: np.ndarray, low: int) -> None:
        """out += X[:, low:low + len(out)]' . y"""
        terms = self.idx[self.by_term]
        at = self.by_term[np.searchsorted(terms, low):np.searchsorted(terms, low + len(out))]
        terms, sums = segment_sums(self.idx[at], y[self.row[at]] * self.val[at, None])
        out[terms - low] += sums


def pack_docs(doc_terms: DataFrame, terms: DataFrame, docs: DataFrame | None = None,
              max_features: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """PACKED from (article_id, term, tfidf) and terms(term, term_id).
    ``docs`` (article_id) adds documents without any term; ``start`` (article_id, w) rides
    along. Written to the shared folder."""
    spark = doc_terms.sparkSession
    n = text_partitions(spark)
    ids = terms.select("term", "term_id")
    if max_features is not None and max_features <= BROADCAST_MAX_ROWS:
        ids = F.broadcast(ids)                                      # max_features rows
    rows = (doc_terms.join(ids, "term").repartition(n, "article_id").groupBy("article_id")
            .agg(F.sort_array(F.collect_list(F.struct("term_id", F.col("tfidf").cast("double").alias("x")))).alias("row")))
    if docs is not None:
        rows = docs.select("article_id").where("article_id is not null").distinct().join(rows, "article_id", "left")
    if start is not None:
        rows = rows.join(start.select("article_id", "w"), "article_id", "left")
    else:
        rows = rows.withColumn("w", F.lit(None).cast("array<double>"))
    rows = rows.select("article_id", F.col("row.term_id").alias("idx"), F.col("row.x").alias("val"), "w")
    kind = dict(rows.dtypes)["article_id"]

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                many = pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                idx = np.asarray(part.column(1).flatten(), np.int32)
                val = np.asarray(part.column(2).flatten(), np.float64)
                start_ = np.asarray(part.column(3).flatten(), np.float64)
                yield matrix_row(number, part.column(0), many, idx, val, float(val @ val), start_)
                number += 1
    packed = rows.mapInArrow(run, PACKED.format(kind))
    return spark.read.parquet(write_table(packed, "blocks"))


class DocBlocks:
    """The packed matrix X, dealt by block and kept, and passes over it. ``idf`` (by term_id)
    is given if it is packed as occurrences."""

    def __init__(self, packed: DataFrame, n_terms: int, block_bytes: int = BROADCAST_BYTES, *, idf: np.ndarray | None = None):
        self.spark = packed.sparkSession
        ensure_checkpoint_dir(self.spark)
        ship_package(self.spark)
        self.packed, self.n_terms, self.block_bytes = packed, n_terms, block_bytes
        self.idf = None if idf is None else self.spark.sparkContext.broadcast(idf)       # n_terms numbers
        self.tasks = max(1, min(text_partitions(self.spark), self.spark.sparkContext.defaultParallelism))
        self.latest: dict[str, str] = {}
        self.x = (packed.select("block", *(c for c, _ in _MATRIX)).repartition(self.tasks, "block").sortWithinPartitions("block")
                  .persist(StorageLevel.MEMORY_AND_DISK))

    def close(self) -> None:
        self.x.unpersist()
        if self.idf is not None:
            self.idf.destroy()

    def stored(self, rows: DataFrame, name: str, schema: str) -> DataFrame:
        """``rows`` written to the shared folder; what was stored under ``name`` before, from
        which they were made, is removed."""
        path = write_table(rows, name)
        before, self.latest[name] = self.latest.get(name), path
        if before:
            drop_table(self.spark, before)
        return self.spark.read.schema(schema).parquet(path)

    def chunk_terms(self, columns: int) -> int:
        return max(1, CHUNK_BYTES // (8 * max(1, columns)))

    def sent(self, m: np.ndarray) -> list[tuple[int, object]]:
        """(first term, broadcast rows) of the term blocks of ``m``; whole chunks each."""
        chunk = self.chunk_terms(m.shape[1])
        rows = max(1, self.block_bytes // (8 * max(1, m.shape[1])) // chunk) * chunk
        return [(low, self.spark.sparkContext.broadcast(m[low:low + rows])) for low in range(0, max(1, len(m)), rows)]

    def run(self, m: np.ndarray, update: Callable, state: DataFrame | None = None, transposed: bool = True,
            gram: bool = False) -> DataFrame:
        """STATE rows after one pass: dense = update(dense before, X . m) of every block,
        and, as chunks, X' dense and dense' dense."""
        rows = self.x.join(state.select("block", "dense"), "block") if state is not None else self.x.withColumn(
            "dense", F.lit(None).cast("binary"))
        rows = rows.select("block", *(c for c, _ in _MATRIX), "dense", F.lit(None).cast("binary").alias("y"),
                           F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("binary").alias("part"))
        blocks, columns = self.sent(m), m.shape[1]
        steps = [(True, b, k == len(blocks) - 1, k == len(blocks) - 1) for k, b in enumerate(blocks)]
        if transposed:
            steps += [(False, b, False, True) for b in blocks[:-1]]
        for k, (product, block, updates, adds) in enumerate(steps):
            rows = _step(rows, block, columns, self.idf, self.chunk_terms(columns), product, update if updates else None,
                         adds and transposed, gram and updates, last=k == len(steps) - 1)
        state = self.stored(rows, "state", STATE)
        for _, block in blocks:
            block.destroy()
        return state

    def merged(self, state: DataFrame, gram: bool) -> DataFrame:
        """(chunk, part): the sums of all tasks."""
        parts = state.where((F.col("chunk") == GRAM) if gram else (F.col("chunk") >= 0)).select("chunk", "part")
        tasks = self.tasks
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(tasks))).groupBy("chunk", "salt").applyInArrow(
                _sum_parts, "chunk int, part binary")
        return parts.groupBy("chunk").applyInArrow(_sum_parts, "chunk int, part binary")

    def gram(self, state: DataFrame, columns: int) -> np.ndarray:
        row = self.merged(state, True).first()
        return np.frombuffer(row["part"]).reshape(columns, columns) if row else np.zeros((columns, columns))

    def transposed(self, state: DataFrame, columns: int) -> np.ndarray:
        """X' dense on the driver: terms x columns, bounded by the model's size."""
        out, chunk = np.zeros((self.n_terms, columns)), self.chunk_terms(columns)
        for r in self.merged(state, False).collect():
            part = np.frombuffer(r["part"]).reshape(-1, columns)
            out[r["chunk"] * chunk:r["chunk"] * chunk + len(part)] = part
        return out

    def rows(self, state: DataFrame, name: str = "w") -> DataFrame:
        """(article_id, name array<double>) of every packed document."""
        kind = dict(self.packed.dtypes)["ids"][len("array<"):-1]
        own = self.packed.select("block", "ids").join(state.where("block is not null").select("block", "dense"), "block")

        def run(batches):
            for batch in batches:
                for ids, dense in zip(batch.column(0), batch.column(1).to_pylist()):
                    n = len(ids)
                    values = np.frombuffer(dense)
                    ends = pa.array(np.arange(n + 1) * (len(values) // max(1, n)), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(ends, pa.array(values))],
                                                     names=["article_id", name])
        return own.select("ids", "dense").mapInArrow(run, f"article_id {kind}, {name} array<double>")


def _sum_parts(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b) for b in table.column("part").to_pylist()], axis=0)
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()),
                     "part": pa.array([total.tobytes()], pa.binary())})


def _step(rows: DataFrame, block, columns: int, idf, chunk: int, product: bool, update, transposed: bool,
          gram: bool, last: bool) -> DataFrame:
    low, sent = block
    between = pa.schema([("block", pa.int64()), *_MATRIX, ("dense", pa.binary()), ("y", pa.binary()),
                         ("chunk", pa.int32()), ("part", pa.binary())])

    def run(batches):
        m = sent.value
        added = np.zeros_like(m) if transposed else None
        squares = None
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            out = []
            for r in batch.to_pylist():
                if r["block"] is not None:
                    x = Sparse(*(r[c] for c, _ in _MATRIX), None if idf is None else idf.value)
                    if product:
                        y = np.frombuffer(r["y"]).reshape(x.n, columns).copy() if r["y"] is not None else np.zeros((x.n, columns))
                        x.add_times(y, m, low)
                        r["y"] = y.tobytes()
                    if update is not None:
                        dense = update(np.frombuffer(r["dense"]).reshape(x.n, -1) if r["dense"] is not None else None, y)
                        r["dense"], r["y"] = dense.tobytes(), None
                        if gram:
                            squares = dense.T @ dense + (0 if squares is None else squares)
                    if transposed:
                        x.add_transposed(added, np.frombuffer(r["dense"]).reshape(x.n, columns), low)
                out.append(r)
            table = pa.RecordBatch.from_pylist(out, between)
            yield table.select(_STATE.names) if last else table
        parts = [(GRAM, squares)] if squares is not None else []
        if added is not None:
            some = np.flatnonzero(added.any(1)) // chunk
            parts += [((low // chunk) + int(k), added[k * chunk:(k + 1) * chunk]) for k in np.unique(some)]
        if parts:
            table = pa.RecordBatch.from_pylist([{"chunk": k, "part": np.ascontiguousarray(p).tobytes()} for k, p in parts], between)
            yield table.select(_STATE.names) if last else table
    return rows.mapInArrow(run, STATE if last else f"block long, {MATRIX}, dense binary, y binary, chunk int, part binary")
