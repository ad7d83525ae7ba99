"""Row filters and projections over the article table.

All predicates are plain Catalyst expressions on stored columns, so they reach
the Parquet scan as pushed filters (string bounds on pub_date included).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_key
from ..functions.text import doc_word_count
from ..session import broadcast_small

# --- fixed values: URL prefixes known to fail to scrape ---------------------
URLS_TO_IGNORE = [
    "http://www.nytimes.com/video",
    "http://www.legacy.com",
    "http://www.nytimes.com/slideshow",
    "http://cooking.nytimes.com/recipes",
    "http://www.nytimes.com/interactive",
]
# ---------------------------------------------------------------------------


def filter_news_uncleaned(articles: DataFrame, overwrite: bool = False) -> DataFrame:
    """News articles with a body; unless ``overwrite``, only those not yet cleaned."""
    cond = (F.col("full_text").isNotNull() & (F.col("full_text") != "")
            & (F.col("type_of_material") == "News"))
    if not overwrite:
        cond = cond & F.col("clean_text").isNull()
    return articles.filter(cond)


def filter_needs_body(articles: DataFrame) -> DataFrame:
    """News articles of type 'article' still lacking a body and not marked failed."""
    return articles.filter((F.col("document_type") == "article") & (F.col("full_text") == "")
                           & (F.col("type_of_material") == "News")
                           & F.col("failed_scrape").isNull())


def date_range_predicate(start: str | None, end: str | None, bounds: str = "closed",
                         col: str = "pub_date") -> Column:
    """String bounds on pub_date. 'closed': >= start and <= end; 'open': > and <;
    'half_open': >= and <. Bounds are never cast to dates."""
    c = F.col(col)
    lo_op, hi_op = {"closed": (c.__ge__, c.__le__), "open": (c.__gt__, c.__lt__),
                    "half_open": (c.__ge__, c.__lt__)}[bounds]
    cond = F.lit(True)
    if start is not None:
        cond = cond & lo_op(F.lit(start))
    if end is not None:
        cond = cond & hi_op(F.lit(end))
    return cond


def filter_date_range(articles: DataFrame, start: str | None, end: str | None,
                      bounds: str = "closed") -> DataFrame:
    return articles.filter(date_range_predicate(start, end, bounds))


def filter_min_length(articles: DataFrame, min_doc_length: int | None = None) -> DataFrame:
    if min_doc_length is None:
        return articles
    return articles.filter(doc_word_count("clean_text") >= min_doc_length)


def filter_scored_news(articles: DataFrame, doc_topics: DataFrame, model_name: str,
                       start: str | None = None, end: str | None = None,
                       bounds: str = "open") -> DataFrame:
    """News articles that have weights for ``model_name`` (optionally in a date
    range); returns article columns plus ``weights``."""
    w = doc_topics.filter(F.col("model_name") == model_name).select("article_id", "weights")
    a = articles.filter((F.col("type_of_material") == "News")
                        & date_range_predicate(start, end, bounds))
    return a.join(w, "article_id")


def filter_relevant(df: DataFrame, threshold: float, col: str = "relevance") -> DataFrame:
    """relevance >= threshold (inclusive) after a cast to double."""
    return df.withColumn(col, F.col(col).cast("double")).filter(F.col(col) >= F.lit(float(threshold)))


def filter_topic_keep(topic_rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of ``topic_rows`` whose topic is kept; ``topics`` has one row per topic."""
    kept = topics.filter(F.col("keep")).select("topic")
    return topic_rows.join(broadcast_small(kept), "topic", "left_semi")


def filter_recent_days(articles: DataFrame, n_days: int = 7, as_of: str | None = None) -> DataFrame:
    """Articles published in the ``n_days`` days up to ``as_of`` (default: the
    latest publication day in the table, computed as a scalar subquery)."""
    day = day_key("pub_date").try_cast("date")
    if as_of is None:
        ref = articles.select(F.max(day)).scalar()
    else:
        ref = F.to_date(F.lit(as_of))
    # ISO strings compare like their days, so the bounds need no cast of the column
    since, until = (F.date_add(ref, n).cast("string") for n in (1 - n_days, 1))
    return articles.filter((F.col("pub_date") >= since) & (F.col("pub_date") < until) & day.isNotNull())


def filter_ignore_urls(articles: DataFrame, prefixes=None) -> DataFrame:
    prefixes = URLS_TO_IGNORE if prefixes is None else list(prefixes)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("web_url").startswith(p)
    return articles.filter(~cond)


def scan_clean_text(articles: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(article_id, clean_text) for rows with a non-empty clean text."""
    cond = F.col("clean_text").isNotNull() & (F.col("clean_text") != "")
    if predicate is not None:
        cond = cond & predicate
    return articles.filter(cond).select("article_id", "clean_text")


def project_tooltip(articles: DataFrame) -> DataFrame:
    """(article_id, pub_date[:10], lead_paragraph, headline, web_url)."""
    return articles.select("article_id", day_key("pub_date").alias("pub_date"),
                           "lead_paragraph", "headline", "web_url")
