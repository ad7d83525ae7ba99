"""Plan-shape checks: the properties the design relies on at scale."""
from pyspark.sql import functions as F

from trendlens.operators import ingest as IN
from trendlens.operators import topic_stats as TS
from trendlens.operators.topic_terms import join_topic_names
from trendlens.plans.trends import smooth_trend
from trendlens.sources.sinks import join_best_metadata
from trendlens.operators.filters import filter_date_range
from trendlens.operators.tfidf import tfidf_transform
from trendlens.sources.fixtures import build_fixture

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_doc_terms_one_text_shuffle(spark):
    fx = build_fixture(spark, SF)
    p = plan(tfidf_transform(fx.articles.filter(F.col("clean_text") != ""), fx.tfidf))
    assert p.count("REPARTITION_BY_NUM") == 1          # the only move of the text
    assert "ENSURE_REQUIREMENTS" not in p                # counts, join, norm: no other shuffle
    assert "BroadcastHashJoin" in p                      # vocabulary (<= max_features rows)


def test_top_k_partial_limit_before_shuffle(spark):
    fx = build_fixture(spark, SF)
    p = plan(TS.best_overall(fx.doc_topics, fx.articles))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_first_per_url_partial_aggregation(spark):
    a = build_fixture(spark, SF).articles.withColumn("batch_pos", F.col("article_id"))
    p = plan(IN.first_per_url(a.select("article_id", "web_url", "batch_pos")))
    assert "partial_min_by" in p


def test_string_bounds_pushed_to_scan(spark):
    fx = build_fixture(spark, SF)
    q = filter_date_range(fx.articles, "2001-10", "2001-11", "closed").select("article_id")
    p = plan(q)
    assert "PushedFilters" in p and "GreaterThanOrEqual(pub_date,2001-10)" in p
    assert "LessThanOrEqual(pub_date,2001-11)" in p


def test_topics_dimension_broadcast(spark):
    fx = build_fixture(spark, SF)
    p = plan(join_topic_names(fx.doc_topics.select(F.posexplode("weights").alias("topic", "w")), fx.topics))
    assert "BroadcastHashJoin" in p


def test_relevance_is_computed_inside_rows(spark):
    fx = build_fixture(spark, SF)
    p = plan(TS.article_relevance(fx.raw_doc_topics, fx.topics))
    assert "Exchange" not in p and "Join" not in p


def test_trend_reads_the_stored_rollup_only(spark):
    fx = build_fixture(spark, SF)
    p = plan(smooth_trend(fx.doc_topics, fx.articles, 8, normalize=True))
    assert "FileScan" not in p


def test_best_articles_go_to_the_articles(spark):
    fx = build_fixture(spark, SF)
    p = plan(join_best_metadata(TS.best_overall(fx.doc_topics, fx.articles), fx.articles))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
