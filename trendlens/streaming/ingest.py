"""Incremental ingest as a Structured Streaming job.

Landed search results (JSON lines) stream in. A micro-batch is dealt by URL and keeps the
first record of each. URLs seen before are known to the stream's state, keyed by URL in
the state store: a micro-batch looks up the URLs it brings and nothing else, so its work
does not grow with the table; Spark's own operator does so, without a call of Python for
a URL. The first record of every new URL goes on to ``foreachBatch``: attach bodies,
clean, score with the topic model.

Output tables are partitioned by ``batch_id`` and each batch overwrites only its own
partition; a retried batch reads the state as it was before it, so it writes the same
rows again. A table that exists before the stream starts is a second stream, of URLs
only: its rows enter the state with the first micro-batch and come before all records.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.html import DEFAULT_RULES
from ..operators.ingest import ARTICLE_COLUMNS, bodies_of, clean_missing, first_per_url, land_articles
from ..operators.project import TopicModel, store_topic_weights
from ..session import drop_table, text_partitions, write_table
from ..sources.tables import landed_schema

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ["query", "page", "pos"]              # the order records came in
LEAST_ROWS = 50_000                           # records that are compared at once


def _firsts(table: pa.Table) -> pa.Table:
    """The first record of each URL, in the order they are in."""
    order = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("web_url", "record", *ORDER)]))
    urls = table.column("web_url").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    return table.take(pa.array(np.sort(order[np.flatnonzero(np.diff(urls, prepend=-1))])))


def first_of_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of every URL of a task: known URLs before records, records by
    ORDER, equal ones as they come. One record of a URL is held, however many it has."""
    held, rows, first = [], 0, 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows - first >= max(LEAST_ROWS, first):             # at least as many new ones as are held
            held = [_firsts(pa.concat_tables(held))]
            rows = first = held[0].num_rows
    if rows:
        yield from _firsts(pa.concat_tables(held)).to_batches(max_chunksize=10_000)


def known_urls(spark: SparkSession, known: DataFrame | None, checkpoint: str) -> str:
    """The folder of the URLs known before the first start; a later start finds it."""
    path = f"{checkpoint}/known"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        urls = known.select("web_url") if known is not None else spark.range(0).selectExpr("cast(id as string) as web_url")
        urls.where("web_url is not null").distinct().write.mode("overwrite").parquet(path)
    return path


def ingest_new(spark: SparkSession, new: DataFrame, batch_id: int, out: str, pages: DataFrame, model: TopicModel,
               model_name: str, rules=DEFAULT_RULES) -> None:
    """Attach bodies to new records, clean, score, and write them as one batch."""
    art_path = f"{out}/articles"
    rows = new.join(bodies_of(new, pages, rules), "web_url", "left")
    got = F.col("body").isNotNull() & (F.col("body") != "")
    rows = rows.select(
        *[F.when(got, F.col("body")).otherwise(F.lit("")).alias(c) if c == "full_text"
          else F.when(got, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias(c)
          if c == "failed_scrape" else F.lit(None).cast("string").alias(c) if c == "clean_text"
          else F.col(c) for c in ARTICLE_COLUMNS])
    (clean_missing(rows).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(art_path))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])      # there may be no file yet
    written = (spark.read.schema(schema).parquet(art_path).filter(F.col("batch_id") == batch_id)
               .drop("batch_id"))
    dt = store_topic_weights(written, model, model_name)
    (dt.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
     .parquet(f"{out}/doc_topics"))


def process_batch(spark: SparkSession, landed: DataFrame, batch_id: int, out: str, pages: DataFrame, model: TopicModel,
                  model_name: str, rules=DEFAULT_RULES, max_pages: int = 10, known: DataFrame | None = None) -> None:
    """The ingest of landed results as a plain batch job; ``known`` (web_url) are URLs in
    the table already."""
    first = first_per_url(land_articles(landed, max_pages).withColumn("batch_pos", F.struct(*ORDER)))
    if known is not None:
        first = first.join(known.select("web_url"), "web_url", "left_anti")
    ingest_new(spark, first, batch_id, out, pages, model, model_name, rules)


def stream_ingest(spark: SparkSession, landing: str, pages: DataFrame, model: TopicModel,
                  out: str, checkpoint: str, model_name: str = "model", rules=DEFAULT_RULES,
                  max_files_per_trigger: int | None = None, available_now: bool = True,
                  id_type: T.DataType = T.StringType(), known: DataFrame | None = None, max_pages: int = 10):
    """Start the streaming ingest; returns the StreamingQuery. ``known`` (web_url) are the
    URLs of a table that exists before the first start."""
    spark.conf.set(STORE, ROCKS)
    reader = spark.readStream.schema(landed_schema(id_type))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = land_articles(reader.json(landing), max_pages).where("web_url is not null")
    urls = spark.readStream.schema("web_url string").parquet(known_urls(spark, known, checkpoint))
    both = records.withColumn("record", F.lit(1)).unionByName(urls.withColumn("record", F.lit(0)), allowMissingColumns=True)
    first = both.repartition(text_partitions(spark), "web_url").mapInArrow(first_of_urls, both.schema)
    new = first.dropDuplicates(["web_url"]).where("record = 1").drop("record")

    def run(batch_df: DataFrame, batch_id: int) -> None:
        path = write_table(batch_df, "batch", spark)      # the state runs once a batch, whatever reads its rows
        try:
            ingest_new(spark, spark.read.schema(batch_df.schema).parquet(path), batch_id, out, pages, model, model_name, rules)
        finally:
            drop_table(spark, path)

    w = new.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def write_landing(records: DataFrame, landing: str, n_files: int = 4) -> str:
    """Write landed search results as JSON lines."""
    records.repartition(n_files).write.mode("errorifexists").json(landing)
    return landing


__all__ = ["stream_ingest", "process_batch", "write_landing"]
