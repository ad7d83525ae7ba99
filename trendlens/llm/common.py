"""Shared helpers of the training-data operators."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read through Spark so that any store it supports works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_ROWS = 2000                # whole texts in an Arrow batch, at most
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = 4 << 20            # of them, and one row
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Shared folder and package shipping, once per application, and Arrow batches that
    suit rows of whole texts: every worker and its task hold one or more of them."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_BYTES, None) is None:             # a session may have its own
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def release() -> None:
    """Free memory goes back to the system, which Arrow's pool and the C library else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """``run`` of a task's batches with its free memory released at its end: Spark keeps
    the worker for later tasks, and while the JVM alone is at work."""
    def until_done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return until_done


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_WORDS = 1 << 20           # of 64 bits each


def with_hit(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a column ``hit``: true where ``key`` is one of the ids, false for nearly
    all others. A bit is set for the hash of every id, and the words of bits
    (``FILTER_WORDS`` at most) are sent to the rows, which no shuffle moves."""
    def place(c):
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(64 * FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = (ids.where(F.col(id_col).isNotNull()).select(place(id_col).alias("_place"))
             .groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    marked = rows.withColumn("_place", place(key)).withColumn("_word", F.shiftright("_place", 6))
    hit = F.col(key).isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.join(F.broadcast(words), "_word", "left").withColumn("hit", hit).select(*(F.col(c) for c in rows.columns), "hit")


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` bytes of text each, at least one row."""
    a, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): smallest node reachable over undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds (Kiveris et al.). Every round
    groups by node with partial aggregation and joins back, so a hub is split
    by the skew join; each round's edges are written to the shared folder.
    Nodes without an edge are absent. Self loops and nulls are ignored.
    """
    e = stored(edges.where("a is not null and b is not null and a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .distinct(), "cc")
    spark = edges.sparkSession
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("n")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = stored(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(low, F.col("u") == F.col("n"))
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(joined.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        new = stored(small, "cc")
        # a star forest: every node points to one smaller node that points nowhere
        tops = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        chained = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        e = new
        if tops["n"] == tops["d"] and chained:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
