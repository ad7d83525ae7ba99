"""A rollup of scored articles by month, type and topic, kept by adding increments.

Every column is a mergeable partial (counts, a sum, the smallest of a struct), so the
rollup of all articles is the merge of the rollups of any parts of them: a day's articles
are rolled up once and merged, and trends, month grids and monthly best articles read
months x types x topics rows instead of the weights.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key, month_sequence
from ..functions.numbers import order_key
from .project import with_record_columns
from .topic_stats import topics_of
from .windows import argmax_topic, ranked_topics_col

KEYS = ["month", "type_of_material", "topic"]
COUNTS = ["n_docs", "n_ranked", "n_best", "n_over", "n_strong"]


def topic_rollup(doc_topics: DataFrame, articles: DataFrame, rank_number: int = 3, topic_threshold: float = .001,
                 doc_topic_threshold: float = .1) -> DataFrame:
    """(KEYS, COUNTS, weight_sum, best): of the articles of a month and type, how many
    there are (n_docs), have the topic among their ``rank_number`` highest (n_ranked), have
    it as highest (n_best), weigh it above either threshold (n_over, n_strong); the sum
    of its weights; and the article that weighs it most, if any is above 0 (ties: lowest id)."""
    dt = with_record_columns(doc_topics, articles, ["pub_date", "type_of_material"])
    ranked = F.transform(ranked_topics_col("weights", rank_number), lambda s: s["topic"])
    long = dt.select("article_id", month_key("pub_date").alias("month"), "type_of_material", ranked.alias("ranked"),
                     argmax_topic("weights").alias("highest"), F.posexplode("weights").alias("topic", "weight"))
    count = lambda condition: F.sum(condition.cast("long"))
    w = F.col("weight")
    return long.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_docs"), count(F.array_contains("ranked", F.col("topic"))).alias("n_ranked"),
        count(F.col("topic") == F.col("highest")).alias("n_best"), count(w > topic_threshold).alias("n_over"),
        count(w > doc_topic_threshold).alias("n_strong"), F.sum(w).alias("weight_sum"),
        F.min(F.when(w > 0, F.struct((-order_key("weight")).alias("key"), "article_id", "weight"))).alias("best"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """The rollup of the articles of all parts (disjoint sets of articles)."""
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.sum("weight_sum").alias("weight_sum"), F.min("best").alias("best"))


def over_types(rollup: DataFrame, types=None) -> DataFrame:
    """The rollup over article types (all, or the given ones): keys month, topic."""
    kept = rollup if types is None else rollup.where(F.col("type_of_material").isin(*types))
    return merge_rollups(kept.withColumn("type_of_material", F.lit(None).cast("string"))).drop("type_of_material")


def month_grid(rollup: DataFrame, value: str, start: str, end: str, n_topics: int, extra: int = 0) -> DataFrame:
    """(month, topic, value) for every month start..end and topic of K."""
    spine = month_sequence(topics_of(rollup, n_topics), start, end, extra=extra)
    return spine.join(rollup.select("month", "topic", value).where(F.col("month").between(start, end)), ["month", "topic"], "left")


def empire_counts_of(rollup: DataFrame, n_topics: int, start: str = "2001-10", end: str = "2014-11",
                     only_best_match: bool = True) -> DataFrame:
    """``topic_stats.empire_counts`` from the rollup: (month, topic, n)."""
    value = "n_best" if only_best_match else "n_strong"
    return month_grid(over_types(rollup), value, start, end, n_topics, 1).select(
        "month", "topic", F.coalesce(value, F.lit(0)).alias("n"))


def best_per_month_of(rollup: DataFrame, n_topics: int, start: str = "2001-09", end: str = "2014-11") -> DataFrame:
    """``topic_stats.best_per_month`` from the rollup: (month, topic, article_id, weight)."""
    return month_grid(over_types(rollup, ["News"]), "best", start, end, n_topics).select(
        "month", "topic", F.col("best.article_id").alias("article_id"), F.coalesce("best.weight", F.lit(0.0)).alias("weight"))
