"""Composite topic trend over time (ranked, threshold and normalised variants).

Plan: scored News articles -> one rollup by month and topic with partial aggregation
(``operators/rollup.py``), stored -> a generated month x topic spine (months of the
rollup) -> rolling mean per topic -> label shift. Everything after the rollup is months x
topics rows; with a rollup that is kept, nothing else is read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import shift_back_weeks
from ..operators.project import with_record_columns
from ..operators.rollup import over_types, topic_rollup
from ..operators.windows import rolling_month_mean


def trend_start(month_interval: int) -> str:
    if not 1 <= month_interval <= 9:
        raise ValueError("month_interval must be in 1..9")
    return f"2001-0{10 - month_interval}"


def month_topic_spine(monthly: DataFrame, n_topics: int) -> DataFrame:
    """(month, mdate, topic) for every month from the first to the last month in
    ``monthly`` and every topic; generated from one aggregate row."""
    bounds = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = bounds.select(F.explode(F.sequence(
        F.to_date(F.concat("lo", F.lit("-01"))), F.to_date(F.concat("hi", F.lit("-01"))),
        F.expr("interval 1 month"))).alias("mdate"))
    return months.select(F.date_format("mdate", "yyyy-MM").alias("month"), "mdate",
                         F.explode(F.sequence(F.lit(0), F.lit(n_topics - 1))).alias("topic"))


def smooth_trend(doc_topics: DataFrame, articles: DataFrame, n_topics: int, ranked: bool = True,
                 rank_number: int = 3, topic_threshold: float = .001, month_interval: int = 3,
                 normalize: bool = False, empty_month: str = "null", start: str | None = None) -> DataFrame:
    """Long trend (date, topic, value) of scored News: the weights are read once, for
    the rollup."""
    start = trend_start(month_interval) if start is None else start
    dt = with_record_columns(doc_topics, articles, ["pub_date", "type_of_material"])
    dt = dt.where((F.col("type_of_material") == "News") & (F.col("pub_date") > F.lit(start)))
    rollup = topic_rollup(dt, articles, rank_number, topic_threshold).checkpoint(eager=True)   # months x topics rows
    return smooth_trend_of(rollup, n_topics, ranked, month_interval, normalize, empty_month, start)


def smooth_trend_of(rollup: DataFrame, n_topics: int, ranked: bool = True, month_interval: int = 3,
                    normalize: bool = False, empty_month: str = "null", start: str | None = None) -> DataFrame:
    """Long trend (date, topic, value) from a stored rollup: News from the month of
    ``start`` (default: as the interval asks), counts of ranked topics or of weights above
    the rollup's threshold."""
    start = trend_start(month_interval) if start is None else start
    counts = over_types(rollup.where(F.col("month") >= start[:7]), ["News"]).select(
        "month", "topic", F.col("n_docs").alias("total"), F.col("n_ranked" if ranked else "n_over").alias("n"))
    m = month_topic_spine(counts, n_topics).join(counts, ["month", "topic"], "left")
    if empty_month == "null":
        value = F.col("n")                       # a month with articles has a row a topic
    elif empty_month == "zero":
        value = F.coalesce("n", F.lit(0))
    else:
        raise ValueError("empty_month is 'null' or 'zero'")
    m = m.select("month", "mdate", "topic", value.cast("double").alias("value"),
                 F.coalesce("total", F.lit(0)).cast("double").alias("total"))
    m = rolling_month_mean(m, month_interval, "value")
    if normalize:
        m = rolling_month_mean(m, month_interval, "total")
        m = m.withColumn("value", F.try_divide(F.col("value"), F.col("total")))
    return m.select(shift_back_weeks("mdate", month_interval).alias("date"), "topic",
                    F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
