"""Topic description operators over the long topic-term table (topic, term, weight).

Each window is partitioned by topic and holds at most the vocabulary size
(``max_features``) rows; ``row_number() <= n`` becomes a WindowGroupLimit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order_key
from ..session import broadcast_small


def topic_top_terms(topic_terms: DataFrame, n_top_words: int = 20) -> DataFrame:
    """(topic, rank, term, pct): the n_top_words-1 heaviest terms per topic (the
    reference's reversed slice keeps n-1), pct = 100 * weight / sum of the kept
    weights, null for a topic without weight. Ties: order key of the weight desc, then the alphabetically later term."""
    w = Window.partitionBy("topic").orderBy(F.desc(order_key("weight")), F.desc("term"))
    top = (topic_terms.withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= n_top_words - 1))
    pct = F.try_divide(F.lit(100.0) * F.col("weight"), F.sum("weight").over(Window.partitionBy("topic")))
    return top.select("topic", "rank", "term", pct.alias("pct"))


def topic_concise_terms(top_terms: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, pct): the n best terms per topic by pct."""
    w = Window.partitionBy("topic").orderBy(F.desc(order_key("pct")), F.desc("term"))
    return (top_terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("topic", "rank", "term", "pct"))


def topic_terms_ranked(top_terms: DataFrame) -> DataFrame:
    """All described terms of each topic, ranked by descending pct."""
    w = Window.partitionBy("topic").orderBy(F.desc(order_key("pct")), F.desc("term"))
    return top_terms.withColumn("rank", F.row_number().over(w)).select("topic", "rank", "term", "pct")


def sample_topics(topics: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """n distinct topics in a seeded pseudo-random order (MD5 of topic and seed,
    reproducible in any engine)."""
    key = F.md5(F.concat(F.col("topic").cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return topics.select("topic", key.alias("_k")).orderBy("_k", "topic").limit(n).select("topic")


def join_topic_names(df: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach topic names; ``topics`` has one row per topic (bounded by K)."""
    return df.join(broadcast_small(topics.select("topic", "name")), "topic")
