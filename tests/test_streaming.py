"""Batch = incremental = stream: the streaming ingest over several micro-batches
writes the same article and doc-topic tables as one batch run."""
import json

from pyspark.sql import functions as F

from trendlens.operators.html import TEST_PROFILE_RULES
from trendlens.session import scratch_path
from trendlens.sources.fixtures import build_fixture, landed_records, load_articles, pages_by_url
from trendlens.sources.tables import ARTICLE_SCHEMA, scan_pages
from trendlens.streaming.ingest import process_batch, stream_ingest, write_landing

SF = "/root/testdata/sf0.001"


def _rows(spark, out):
    a = spark.read.parquet(f"{out}/articles").select(
        "article_id", "web_url", "full_text", "failed_scrape", "clean_text")
    d = spark.read.parquet(f"{out}/doc_topics").select(
        "article_id", F.transform("weights", lambda w: F.round(w, 9)).alias("w"))
    return sorted(map(tuple, a.collect())), sorted((r[0], tuple(r[1])) for r in d.collect())


def test_stream_equals_batch(spark):
    fx = build_fixture(spark, SF)
    records = landed_records(load_articles(spark, SF))
    records = records.unionByName(records.filter("article_id % 3 = 0").withColumn("query", F.lit("again")))   # known URLs
    records = records.unionByName(records.limit(20).withColumn("web_url", F.lit(None).cast("string")))
    pages = pages_by_url(scan_pages(spark, SF))
    pages = pages.unionByName(pages.withColumn("html", F.lit("")))                    # two pages a URL
    known = records.filter("article_id < 20").select("web_url")
    batch_out = scratch_path(spark, "batch-ingest")
    process_batch(spark, records.where("web_url is not null"), 0, batch_out, pages, fx.model, "m", TEST_PROFILE_RULES, known=known)
    landing = write_landing(records, scratch_path(spark, "landing"), n_files=3)
    out, ckpt = scratch_path(spark, "stream-ingest"), scratch_path(spark, "stream-ckpt")

    def run():
        q = stream_ingest(spark, landing, pages, fx.model, out, ckpt, "m", TEST_PROFILE_RULES, max_files_per_trigger=1,
                          id_type=ARTICLE_SCHEMA["article_id"].dataType, known=known)
        q.awaitTermination()
        return q
    q = run()
    assert _rows(spark, out) == _rows(spark, batch_out)
    assert spark.read.parquet(f"{out}/articles").where("article_id < 20").count() == 0
    # a micro-batch asks the state for the URLs it brings, and reads its own files only
    for p in q.recentProgress:
        for op in p.stateOperators:
            assert op.numRowsUpdated <= p.numInputRows + 20
    assert max(p.numInputRows for p in q.recentProgress) <= records.count() / 2
    # re-running a finished stream adds nothing (offsets and state are in the checkpoint)
    run()
    assert _rows(spark, out) == _rows(spark, batch_out)
    # the same records landing again add no row
    write_landing(records.withColumn("query", F.lit("later")), f"{landing}/../landing-later", n_files=1)
    names = {r[0] for r in spark.read.parquet(f"{out}/articles").select("article_id").collect()}
    spark.read.json(f"{landing}/../landing-later").write.mode("append").json(landing)
    run()
    assert _rows(spark, out) == _rows(spark, batch_out) and len(names) == len(_rows(spark, batch_out)[0])
    assert json.loads(q.lastProgress.json)["sources"]
