"""Properties from the survey's test strategy, on the sf0.001 fixture."""
from pyspark.sql import functions as F

from trendlens.operators import topic_stats as TS
from trendlens.operators.project import store_topic_weights
from trendlens.operators.windows import rank_topics_per_doc
from trendlens.sources.fixtures import MODEL_NAME, build_fixture

SF = "/root/testdata/sf0.001"


def test_score_missing_rerun_is_noop(spark):
    fx = build_fixture(spark, SF)
    again = store_topic_weights(fx.articles, fx.model, MODEL_NAME, existing=fx.doc_topics)
    assert again.count() == 0


def test_ranked_one_hot_per_doc(spark):
    fx = build_fixture(spark, SF)
    k = fx.model.n_topics
    r = rank_topics_per_doc(fx.doc_topics, 3).groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("topic").alias("d"))
    assert r.filter((F.col("n") != min(3, k)) | (F.col("d") != min(3, k))).count() == 0
    assert r.count() == fx.doc_topics.count()


def test_shares_sum_to_one_and_counts_cover_docs(spark):
    fx = build_fixture(spark, SF)
    shares = TS.topic_freq(fx.raw_doc_topics, fx.articles, "2001-09", "2004-06").select(
        "topic", "share").distinct().collect()
    assert abs(sum(r["share"] for r in shares) - 1.0) < 1e-9
    counts = TS.topic_count_best(fx.doc_topics, fx.articles, "2001-09", "2004-06").collect()
    assert sum(r["n"] for r in counts) == fx.doc_topics.count()
