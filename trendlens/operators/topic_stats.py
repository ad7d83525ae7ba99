"""Per-topic aggregates over scored documents: counts, shares, month grids,
best articles and per-article sums.

Every aggregate groups by topic (or month x topic) after a posexplode of the
weight array and uses partial aggregation, so a topic holding a third of all
weight is combined map-side. Top-k per topic uses ``row_number() <= k`` which
Spark plans as a partial WindowGroupLimit before the shuffle: each map task
ships at most k rows per topic.
"""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order_key
from ..functions.dates import day_bounds, month_key, month_sequence, next_month, weights_sum as _wsum
from ..session import broadcast_small
from .project import with_record_columns
from .filters import date_range_predicate
from .windows import argmax_topic


def topics_of(doc_topics: DataFrame, n_topics: int | None = None) -> DataFrame:
    """(topic) for every index of the weight vectors: 0..n_topics-1 when the
    model's K is given, else read from one row of ``doc_topics``."""
    if n_topics is not None:
        return doc_topics.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic"))
    one = doc_topics.select(F.size("weights").alias("k")).limit(1)
    return one.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("topic"))


def _in_range(doc_topics: DataFrame, articles: DataFrame, start, end, bounds="closed") -> DataFrame:
    """Documents with weights (hence with a non-empty clean text) whose pub_date
    is within string bounds."""
    dt = with_record_columns(doc_topics, articles, ["pub_date"])
    return dt.filter(date_range_predicate(start, end, bounds)).select(
        "article_id", "pub_date", "weights")


def topic_freq(doc_topics: DataFrame, articles: DataFrame, start: str, end: str,
               n_articles: int = 1, topic_freq_threshold: float = .1) -> DataFrame:
    """(topic, share, rank, article_id): each topic's share of the summed weights
    in [start, end] and, when the share is above the threshold, its best
    ``n_articles`` articles (rank 1..n); null otherwise. Zero total -> null."""
    long = _in_range(doc_topics, articles, start, end).select(
        "article_id", F.posexplode("weights").alias("topic", "weight"))
    sums = long.groupBy("topic").agg(F.sum("weight").alias("s"))
    shares = sums.select("topic", F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy()))
                         .alias("share"))
    tops = best_in_range(long, n_articles)
    hot = shares.filter(F.col("share") > F.lit(topic_freq_threshold)).select("topic")
    tops = tops.join(hot, "topic", "left_semi")
    return shares.join(tops.select("topic", "rank", "article_id"), "topic", "left")


def best_in_range(long: DataFrame, n_articles: int) -> DataFrame:
    """(topic, rank, article_id, weight): top ``n_articles`` per topic on the
    weight's order key, then article_id ascending."""
    w = Window.partitionBy("topic").orderBy(F.desc(order_key("weight")), F.asc("article_id"))
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_articles)
            .select("topic", "rank", "article_id", "weight"))


def topic_count_best(doc_topics: DataFrame, articles: DataFrame, start: str, end: str,
                     n_topics: int | None = None) -> DataFrame:
    """(topic, n): documents in [start, end] whose best topic is t; every topic
    listed. ``doc_topics`` should hold length-normalised ('linear') weights."""
    docs = _in_range(doc_topics, articles, start, end)
    counts = docs.groupBy(argmax_topic("weights").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return (topics_of(doc_topics, n_topics).join(counts, "topic", "left")
            .select("topic", F.coalesce("n", F.lit(0)).alias("n")))


def topic_count_threshold(doc_topics: DataFrame, articles: DataFrame, start: str, end: str,
                          doc_topic_threshold: float = .1) -> DataFrame:
    """(topic, n): documents in [start, end] with weight > threshold per topic."""
    long = _in_range(doc_topics, articles, start, end).select(
        F.posexplode("weights").alias("topic", "weight"))
    return long.groupBy("topic").agg(
        F.sum((F.col("weight") > F.lit(doc_topic_threshold)).cast("long")).alias("n"))


def empire_counts(doc_topics: DataFrame, articles: DataFrame, start: str = "2001-10",
                  end: str = "2014-11", only_best_match: bool = True,
                  doc_topic_threshold: float = .1, n_topics: int | None = None) -> DataFrame:
    """(month, topic, n) for every month start..end plus one trailing all-zero
    month; one groupBy over all months, zeros from a generated month x topic spine."""
    docs = _in_range(doc_topics, articles, start, None, "closed").filter(
        F.col("pub_date") < next_month(F.lit(end)))
    if only_best_match:
        hits = docs.select(month_key("pub_date").alias("month"), argmax_topic("weights").alias("topic"))
        counts = hits.groupBy("month", "topic").agg(F.count(F.lit(1)).alias("n"))
    else:
        long = docs.select(month_key("pub_date").alias("month"),
                           F.posexplode("weights").alias("topic", "weight"))
        counts = long.groupBy("month", "topic").agg(
            F.sum((F.col("weight") > F.lit(doc_topic_threshold)).cast("long")).alias("n"))
    spine = month_sequence(topics_of(doc_topics, n_topics), start, end, extra=1)
    return (spine.join(counts, ["month", "topic"], "left")
            .select("month", "topic", F.coalesce("n", F.lit(0)).alias("n")))


def best_overall(doc_topics: DataFrame, articles: DataFrame, start: str = "2001-09",
                 end: str = "2014-11", top_count: int = 25) -> DataFrame:
    """(topic, rank, article_id, weight): top ``top_count`` News articles per
    topic with start < pub_date < end (strict string bounds)."""
    dt = with_record_columns(doc_topics, articles, ["pub_date", "type_of_material"])
    long = dt.filter((F.col("type_of_material") == "News")
                     & date_range_predicate(start, end, "open")).select(
        "article_id", F.posexplode("weights").alias("topic", "weight"))
    return best_in_range(long, top_count)


def best_per_month(doc_topics: DataFrame, articles: DataFrame, start: str = "2001-09",
                   end: str = "2014-11", n_topics: int | None = None) -> DataFrame:
    """(month, topic, article_id, weight): per month start..end and topic, the
    News article with the highest weight > 0 (ties: lowest id); (null, 0.0)
    where none."""
    dt = with_record_columns(doc_topics, articles, ["pub_date", "type_of_material"])
    a = dt.filter((F.col("type_of_material") == "News") & (F.col("pub_date") >= F.lit(start))
                  & (F.col("pub_date") < next_month(F.lit(end))))
    long = (a.select("article_id", month_key("pub_date").alias("month"), "weights")
            .select("month", "article_id", F.posexplode("weights").alias("topic", "weight"))
            .filter(F.col("weight") > 0))
    best = long.groupBy("month", "topic").agg(F.min_by(
        F.struct("article_id", "weight"), F.struct(-order_key("weight"), "article_id")).alias("b"))
    spine = month_sequence(topics_of(doc_topics, n_topics), start, end, extra=0)
    return (spine.join(best, ["month", "topic"], "left")
            .select("month", "topic", F.col("b.article_id").alias("article_id"),
                    F.coalesce(F.col("b.weight"), F.lit(0.0)).alias("weight")))


def weights_sum(doc_topics: DataFrame) -> DataFrame:
    """(article_id, value): sum of an article's topic weights (row-local)."""
    return doc_topics.select("article_id", _wsum("weights").alias("value"))


def article_relevance(doc_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(article_id, value): sum over topics of weight x topic relevance, inside each row.
    The relevance vector (a number a topic of the model) becomes a literal; topics
    without one count 0."""
    known = {r["topic"]: r["r"] for r in topics.select("topic", F.col("relevance").cast("double").alias("r")).collect()}
    vector = F.array(*[F.lit(float(known.get(k) or 0.0)) for k in range(max(known, default=-1) + 1)]).cast("array<double>")
    products = F.zip_with("weights", vector, lambda w, r: F.coalesce(w * r, F.lit(0.0)))
    return doc_topics.select("article_id", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("value"))


def records_by_month(articles: DataFrame, predicate=None) -> DataFrame:
    """(month, n) of matching records; only months present."""
    a = articles if predicate is None else articles.filter(predicate)
    return a.groupBy(month_key("pub_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(articles: DataFrame, start: str = "20130101", end: str = "20131231") -> DataFrame:
    """(day 'yyyymmdd', n) for every calendar day in (start, end] — start
    excluded, end included — with 0 for days without articles."""
    if not start < end:
        raise ValueError("daily_counts needs start < end")
    s, e = F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd")
    first = (datetime.strptime(start, "%Y%m%d") + timedelta(days=1)).strftime("%Y%m%d")
    day = F.substring("pub_date", 1, 10).try_cast("date")
    counts = (articles.filter(day_bounds("pub_date", first, end)).groupBy(day.alias("d"))
              .agg(F.count(F.lit(1)).alias("n")))
    spine = articles.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_add(s, 1), e)).alias("d"))
    return (spine.join(counts, "d", "left")
            .select(F.date_format("d", "yyyyMMdd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")))
