"""Pins for faults found in review: duplicates in an upsert, zero totals, seeds, ids."""
from pyspark.sql import functions as F

from trendlens.functions.dates import normalise_vector
from trendlens.operators.ingest import upsert_articles
from trendlens.operators.nmf import hashed_start
from trendlens.operators.topic_terms import sample_topics, topic_top_terms
from trendlens.operators.windows import share_of_total
from trendlens.sources import fixtures
from trendlens.sources.tables import ARTICLE_SCHEMA


def test_upsert_keeps_one_row_per_id(spark):
    empty = spark.createDataFrame([], ARTICLE_SCHEMA)
    batch = spark.createDataFrame([], ARTICLE_SCHEMA).unionByName(
        spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3")], "article_id long, web_url string"),
        allowMissingColumns=True).withColumn("batch_pos", F.substring("web_url", 2, 1).cast("long"))
    snapshot, _ = upsert_articles(empty, batch)
    assert sorted((r.article_id, r.web_url) for r in snapshot.collect()) == [(1, "u2"), (2, "u3")]


def test_zero_totals_give_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0.0)], "v array<double>, x double")
    row = df.select(normalise_vector("v").alias("v"), share_of_total("x").alias("s")).first()
    assert row["v"] == [None, None] and row["s"] is None
    terms = spark.createDataFrame([(0, "a", 0.0), (0, "b", 0.0)], "topic int, term string, weight double")
    assert {r["pct"] for r in topic_top_terms(terms).collect()} == {None}


def test_sample_topics_follows_its_seed(spark):
    topics = spark.createDataFrame([(i,) for i in range(12)], "topic int")
    picks = {tuple(r["topic"] for r in sample_topics(topics, 3, seed).collect()) for seed in range(6)}
    assert len(picks) > 3


def test_nmf_start_takes_any_id_and_seed(spark):
    for kind, ids in (("long", [(-5,), (10**16,), (3,), (1003,)]), ("string", [("a",), ("",), ("nyt://1",), ("é",)])):
        df = spark.createDataFrame(ids, f"article_id {kind}")
        starts = [tuple(sorted(tuple(r["w"]) for r in hashed_start(df, "article_id", "w", 3, s).collect())) for s in (0, 1000, 2**70)]
        assert all(0 < x <= 1 for s in starts for w in s for x in w)
        assert len(set(starts)) == 3 and all(len(set(s)) == 4 for s in starts)


def test_stage_tables_are_not_kept_across_applications():
    assert not hasattr(fixtures, "_stage_root")
