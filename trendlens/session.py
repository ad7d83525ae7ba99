"""Spark session and shared-folder helpers."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Sizes above which a side is never broadcast; every broadcast in the library is
# guarded by a row bound derived from a model parameter (vocabulary size,
# topic count, month range), not by the data volume.
BROADCAST_MAX_ROWS = 2_000_000


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "trendlens") -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own conf)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment and only read here.
    When it is unset (local tests) a scratch folder is created once.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="trendlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df, name: str, spark: SparkSession | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and return
    its path. Used at stage boundaries: the written table cuts lineage and is
    read back by every later stage (no machine-local state)."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that ``write_table`` wrote and nothing reads any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of DataFrames made within go as soon as an action on them ends,
    not when the driver happens to collect its garbage: loops of jobs would keep them all."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


def text_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-heavy text stages. Text is small in bytes next to
    the work done per byte, so these repartitions use an explicit count (which
    AQE does not coalesce) taken from ``spark.sql.shuffle.partitions``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (the equivalent of
    ``--py-files``): zip it once per application and ``addPyFile`` it."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="trendlens-pyfiles-")
    zpath = os.path.join(out_dir, "trendlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def spread_if_narrow(df):
    """Round-robin repartition to the default parallelism only when the input has
    fewer partitions than that (e.g. one large file with one row group) and the
    next step is CPU-heavy per row. Inputs stored as many files are left alone,
    so large inputs are never shuffled just for parallelism."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def broadcast_small(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows
    (counts at most max_rows + 1 rows); otherwise leave the join to a shuffle.
    Meant for dimension tables such as the K-row topics table."""
    from pyspark.sql import functions as F
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
