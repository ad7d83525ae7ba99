"""Window-style operators: per-document topic ranks, rolling monthly means,
shares of a total.

Per-document ranking works on the weights array inside each row (no shuffle).
Rolling means run over (month, topic) series whose size is months x topics —
bounded by the date range and the model, not by the number of articles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order_key


def ranked_topics_col(weights, rank_number: int = 3) -> Column:
    """array<struct<rw, topic>> of the ``rank_number`` highest topics of a weight
    vector by the weights' order keys, ties to the higher topic."""
    w = F.col(weights) if isinstance(weights, str) else weights
    pairs = F.transform(w, lambda v, i: F.named_struct(F.lit("rw"), order_key(v), F.lit("topic"), i))
    return F.slice(F.sort_array(pairs, asc=False), 1, rank_number)


def rank_topics_per_doc(doc_topics: DataFrame, rank_number: int = 3) -> DataFrame:
    """(article_id, topic, rank): one-hot of each article's top topics."""
    ranked = doc_topics.select("article_id", F.posexplode(ranked_topics_col("weights", rank_number))
                               .alias("pos", "s"))
    return ranked.select("article_id", F.col("s.topic").alias("topic"),
                         (F.col("pos") + 1).alias("rank"))


def argmax_topic(weights) -> Column:
    """Index of the highest weight by order key; ties and all-zero vectors give the
    lowest index."""
    w = F.col(weights) if isinstance(weights, str) else weights
    rw = F.transform(w, order_key)
    return (F.array_position(rw, F.array_max(rw)) - 1).cast("int")


def rolling_month_mean(monthly: DataFrame, interval: int = 3, value_col: str = "value",
                       key: str = "topic") -> DataFrame:
    """Trailing mean over ``interval`` months per ``key``; null until the window
    holds ``interval`` non-null values (a null inside the window poisons it).
    ``monthly`` must be gap-free in ``month`` (build it on a month spine)."""
    w = (Window.partitionBy(key).orderBy("month").rowsBetween(-(interval - 1), 0))
    full = F.count(F.col(value_col)).over(w) == interval
    return monthly.withColumn(value_col, F.when(full, F.avg(F.col(value_col)).over(w)))


def share_of_total(col: str) -> Column:
    """x / sum(x) over all rows (used on K-row per-topic tables); null where the sum is zero."""
    return F.try_divide(F.col(col), F.sum(F.col(col)).over(Window.partitionBy()))
