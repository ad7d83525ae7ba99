"""Registered queries: aggregations, rankings, filters, joins and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numbers import order_key_sql
from ..functions.text import doc_word_count, ngrams, vector_tokens
from ..operators import filters as FL
from ..operators import rollup as RU
from ..operators import topic_stats as TS
from ..operators import topic_terms as TT
from ..operators.project import (filter_unscored, join_relevance, project_topics,
                                 store_topic_weights)
from ..operators.tfidf import corpus_stats, l2_norm_per_doc, partition_docs
from ..operators.tfidf import tfidf_transform
from ..operators.windows import rank_topics_per_doc, rolling_month_mean, share_of_total
from ..session import scratch_path, write_table
from ..sources.fixtures import FIXTURE_NGRAMS, MODEL_NAME, build_fixture, corpus
from ..sources.model_store import open_model, save_model
from .catalog import ORACLE, register
from .oracle import fixture_sql, word_count_expr, _ngram_expr
from .queries_core import _trend_sql, r6
from .trends import smooth_trend_of

K = 8
FULL = ("2001-09", "2004-06")          # string bounds covering every test article

_TOPIC_SPINE = f"(SELECT CAST(range AS INTEGER) AS topic FROM range({K}))"


def _months_sql(lo: str, hi: str) -> str:
    return (f"(SELECT strftime(CAST(m AS DATE), '%Y-%m') AS month FROM unnest(generate_series("
            f"DATE '{lo}-01', DATE '{hi}-01', INTERVAL 1 MONTH)) AS t(m))")


def fx_(spark, sf):
    return build_fixture(spark, sf)


# ------------------------------------------------------------------ aggregations
@register("records_by_month", fixture_sql(
    "SELECT substr(pub_date, 1, 7) AS month, count(*) AS n FROM articles GROUP BY 1"))
def q_records_by_month(spark, sf):
    return TS.records_by_month(fx_(spark, sf).articles)


@register("corpus_monthly_total", fixture_sql("""
SELECT substr(a.pub_date, 1, 7) AS month, count(*) AS n FROM carts a
WHERE a.type_of_material = 'News' AND a.pub_date > '2001-07'
  AND a.article_id IN (SELECT article_id FROM dt) GROUP BY 1"""))
def q_corpus_monthly_total(spark, sf):
    fx = fx_(spark, sf)
    scored = FL.filter_scored_news(fx.articles, fx.doc_topics, MODEL_NAME, "2001-07", None, "open")
    return TS.records_by_month(scored)


@register("daily_counts", fixture_sql("""
, days AS (SELECT CAST(d AS DATE) AS d FROM unnest(generate_series(DATE '2001-09-01',
    DATE '2004-05-31', INTERVAL 1 DAY)) AS t(d)),
c AS (SELECT CAST(substr(pub_date, 1, 10) AS DATE) AS d, count(*) AS n FROM articles
  WHERE CAST(substr(pub_date, 1, 10) AS DATE) > DATE '2001-08-31'
    AND CAST(substr(pub_date, 1, 10) AS DATE) <= DATE '2004-05-31' GROUP BY 1)
SELECT strftime(days.d, '%Y%m%d') AS day, coalesce(c.n, 0) AS n FROM days LEFT JOIN c USING (d)"""))
def q_daily_counts(spark, sf):
    return TS.daily_counts(fx_(spark, sf).articles, "20010831", "20040531")


_INR_RAW = f""",
inr AS (SELECT r.article_id, r.topic, r.raw AS weight FROM raw_dt r JOIN carts a USING (article_id)
  WHERE a.pub_date >= '{FULL[0]}' AND a.pub_date <= '{FULL[1]}')"""

_INR_LIN = f""",
inr AS (SELECT d.article_id, d.topic, d.weight, d.rw, substr(a.pub_date, 1, 7) AS month
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.pub_date >= '{FULL[0]}' AND a.pub_date <= '{FULL[1]}')"""


@register("topic_freq", fixture_sql(_INR_RAW + f""",
sums AS (SELECT topic, sum(weight) AS s FROM inr GROUP BY topic),
shares AS (SELECT topic, s / sum(s) OVER () AS share FROM sums),
tops AS (SELECT topic, rank, article_id FROM (SELECT topic, article_id,
  CAST(row_number() OVER (PARTITION BY topic ORDER BY {order_key_sql('weight')} DESC, article_id) AS INTEGER)
  AS rank FROM inr) WHERE rank <= 1)
SELECT s.topic, round(s.share, 6) AS share, t.rank, t.article_id
FROM shares s LEFT JOIN tops t ON t.topic = s.topic AND s.share > 0.1"""))
def q_topic_freq(spark, sf):
    fx = fx_(spark, sf)
    t = TS.topic_freq(fx.raw_doc_topics, fx.articles, *FULL, n_articles=1, topic_freq_threshold=.1)
    return t.select("topic", r6("share").alias("share"), "rank", "article_id")


@register("share_of_total", fixture_sql("""
, sums AS (SELECT topic, sum(raw) AS s FROM raw_dt GROUP BY topic)
SELECT topic, round(s / sum(s) OVER (), 6) AS share FROM sums"""))
def q_share_of_total(spark, sf):
    fx = fx_(spark, sf)
    long = fx.raw_doc_topics.select(F.posexplode("weights").alias("topic", "w"))
    sums = long.groupBy("topic").agg(F.sum("w").alias("s"))
    return sums.select("topic", r6(share_of_total("s")).alias("share"))


_ARGMAX = """,
mx AS (SELECT article_id, max(rw) AS m FROM inr GROUP BY 1),
best AS (SELECT i.article_id, any_value(i.month) AS month, min(i.topic) AS topic
  FROM inr i JOIN mx USING (article_id) WHERE i.rw = mx.m GROUP BY 1)"""


@register("topic_count_best", fixture_sql(_INR_LIN + _ARGMAX + f""",
c AS (SELECT topic, count(*) AS n FROM best GROUP BY 1)
SELECT k.topic, coalesce(c.n, 0) AS n FROM {_TOPIC_SPINE} k LEFT JOIN c USING (topic)"""))
def q_topic_count_best(spark, sf):
    fx = fx_(spark, sf)
    return TS.topic_count_best(fx.doc_topics, fx.articles, *FULL, n_topics=fx.model.n_topics)


@register("topic_count_threshold", fixture_sql(_INR_LIN + """
SELECT topic, CAST(sum(CASE WHEN weight > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM inr GROUP BY topic"""))
def q_topic_count_threshold(spark, sf):
    fx = fx_(spark, sf)
    return TS.topic_count_threshold(fx.doc_topics, fx.articles, *FULL, doc_topic_threshold=.1)


@register("empire_counts", fixture_sql(f""",
inr AS (SELECT d.article_id, d.topic, d.rw, substr(a.pub_date, 1, 7) AS month
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.pub_date >= '2001-10' AND a.pub_date < '2014-12')""" + _ARGMAX + f""",
c AS (SELECT month, topic, count(*) AS n FROM best GROUP BY 1, 2)
SELECT m.month, k.topic, coalesce(c.n, 0) AS n
FROM {_months_sql('2001-10', '2014-12')} m CROSS JOIN {_TOPIC_SPINE} k
LEFT JOIN c ON c.month = m.month AND c.topic = k.topic"""))
def q_empire_counts(spark, sf):
    fx = fx_(spark, sf)
    return TS.empire_counts(fx.doc_topics, fx.articles, n_topics=fx.model.n_topics)


@register("term_df_ctf", fixture_sql(
    "SELECT term, df, CAST(ctf AS BIGINT) AS ctf FROM stats"))
def q_term_df_ctf(spark, sf):
    fx = fx_(spark, sf)
    return corpus_stats(partition_docs(corpus(fx.articles)), FIXTURE_NGRAMS)


@register("weights_sum", fixture_sql(
    "SELECT article_id, round(sum(weight), 6) AS value FROM dt GROUP BY 1"))
def q_weights_sum(spark, sf):
    return TS.weights_sum(fx_(spark, sf).doc_topics).select("article_id", r6("value").alias("value"))


_RELEVANCE = ", rel AS (SELECT r.article_id, sum(r.raw * t.relevance) AS value FROM raw_dt r " \
             "JOIN topics t USING (topic) GROUP BY 1)"


@register("article_relevance", fixture_sql(_RELEVANCE + "\nSELECT article_id, round(value, 6) AS value FROM rel"))
def q_article_relevance(spark, sf):
    fx = fx_(spark, sf)
    return TS.article_relevance(fx.raw_doc_topics, fx.topics).select(
        "article_id", r6("value").alias("value"))


RELEVANCE_THRESHOLD = 1.0


@register("filter_relevant", fixture_sql(_RELEVANCE + f"""
SELECT article_id, round(value, 6) AS relevance FROM rel WHERE value >= {RELEVANCE_THRESHOLD}"""))
def q_filter_relevant(spark, sf):
    fx = fx_(spark, sf)
    rel = TS.article_relevance(fx.raw_doc_topics, fx.topics).withColumnRenamed("value", "relevance")
    return FL.filter_relevant(rel, RELEVANCE_THRESHOLD).select(
        "article_id", r6("relevance").alias("relevance"))


@register("join_relevance", fixture_sql(_RELEVANCE + """
SELECT c.article_id, c.clean_text, round(r.value, 6) AS relevance
FROM carts c JOIN rel r USING (article_id) WHERE c.clean_text IS NOT NULL"""))
def q_join_relevance(spark, sf):
    fx = fx_(spark, sf)
    rel = TS.article_relevance(fx.raw_doc_topics, fx.topics).withColumnRenamed("value", "relevance")
    return join_relevance(corpus(fx.articles), rel).withColumn("relevance", r6("relevance"))


# ------------------------------------------------------------------ rankings
@register("rank_topics_per_doc", fixture_sql("""
SELECT article_id, topic, rank FROM (SELECT article_id, topic, CAST(row_number() OVER
  (PARTITION BY article_id ORDER BY rw DESC, topic DESC) AS INTEGER) AS rank FROM dt) WHERE rank <= 3"""))
def q_rank_topics_per_doc(spark, sf):
    return rank_topics_per_doc(fx_(spark, sf).doc_topics, 3)


def _best_sql(where: str, n: int, src: str = "dt") -> str:
    return fixture_sql(f""",
inr AS (SELECT d.article_id, d.topic, d.weight, d.rw FROM {src} d JOIN carts a USING (article_id)
  WHERE {where})
SELECT topic, rank, article_id, round(weight, 6) AS weight FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY topic ORDER BY rw DESC, article_id) AS INTEGER) AS rank FROM inr) WHERE rank <= {n}""")


@register("best_overall", _best_sql(
    "a.type_of_material = 'News' AND a.pub_date > '2001-09' AND a.pub_date < '2014-11'", 25))
def q_best_overall(spark, sf):
    fx = fx_(spark, sf)
    return TS.best_overall(fx.doc_topics, fx.articles).select(
        "topic", "rank", "article_id", r6("weight").alias("weight"))


@register("best_in_range", _best_sql(
    f"a.pub_date >= '{FULL[0]}' AND a.pub_date <= '{FULL[1]}'", 3))
def q_best_in_range(spark, sf):
    fx = fx_(spark, sf)
    long = TS._in_range(fx.doc_topics, fx.articles, *FULL).select(
        "article_id", F.posexplode("weights").alias("topic", "weight"))
    return TS.best_in_range(long, 3).select("topic", "rank", "article_id", r6("weight").alias("weight"))


@register("best_per_month", fixture_sql(f""",
inr AS (SELECT d.article_id, d.topic, d.weight, d.rw, substr(a.pub_date, 1, 7) AS month
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.type_of_material = 'News' AND a.pub_date >= '2001-09' AND a.pub_date < '2014-12'
    AND d.weight > 0),
b AS (SELECT month, topic, article_id, weight FROM (SELECT *, row_number() OVER
  (PARTITION BY month, topic ORDER BY rw DESC, article_id) AS rn FROM inr) WHERE rn = 1)
SELECT m.month, k.topic, b.article_id, round(coalesce(b.weight, 0.0), 6) AS weight
FROM {_months_sql('2001-09', '2014-11')} m CROSS JOIN {_TOPIC_SPINE} k
LEFT JOIN b ON b.month = m.month AND b.topic = k.topic"""))
def q_best_per_month(spark, sf):
    fx = fx_(spark, sf)
    return TS.best_per_month(fx.doc_topics, fx.articles, n_topics=fx.model.n_topics).select(
        "month", "topic", "article_id", r6("weight").alias("weight"))


def _top_terms_sql(n_top: int) -> str:
    return f""",
ranked_terms AS (SELECT topic, term, weight, CAST(row_number() OVER (PARTITION BY topic
  ORDER BY {order_key_sql('weight')} DESC, term DESC) AS INTEGER) AS rank FROM topic_terms),
top_terms AS (SELECT topic, rank, term,
  100.0 * weight / sum(weight) OVER (PARTITION BY topic) AS pct
  FROM ranked_terms WHERE rank <= {n_top - 1})"""


@register("topic_top_terms", fixture_sql(_top_terms_sql(20) + """
SELECT topic, rank, term, round(pct, 6) AS pct FROM top_terms"""))
def q_topic_top_terms(spark, sf):
    t = TT.topic_top_terms(fx_(spark, sf).topic_terms, 20)
    return t.select("topic", "rank", "term", r6("pct").alias("pct"))


@register("topic_concise_terms", fixture_sql(_top_terms_sql(30) + f"""
SELECT topic, rank, term, round(pct, 6) AS pct FROM (SELECT topic, term, pct, CAST(row_number()
  OVER (PARTITION BY topic ORDER BY {order_key_sql('pct')} DESC, term DESC) AS INTEGER) AS rank
  FROM top_terms) WHERE rank <= 10"""))
def q_topic_concise_terms(spark, sf):
    t = TT.topic_concise_terms(TT.topic_top_terms(fx_(spark, sf).topic_terms, 30), 10)
    return t.select("topic", "rank", "term", r6("pct").alias("pct"))


@register("topic_terms_ranked", fixture_sql(_top_terms_sql(20) + f"""
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY {order_key_sql('pct')} DESC, term DESC)
  AS INTEGER) AS rank, term, round(pct, 6) AS pct FROM top_terms"""))
def q_topic_terms_ranked(spark, sf):
    t = TT.topic_terms_ranked(TT.topic_top_terms(fx_(spark, sf).topic_terms, 20))
    return t.select("topic", "rank", "term", r6("pct").alias("pct"))


@register("sample_topics", fixture_sql("""
SELECT topic FROM topics ORDER BY md5(CAST(topic AS VARCHAR) || '|0'), topic
LIMIT 3"""))
def q_sample_topics(spark, sf):
    return TT.sample_topics(fx_(spark, sf).topics, 3, seed=0)


@register("load_model", fixture_sql("""
, kept AS (SELECT topic, CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS new_topic
  FROM topics WHERE keep)
SELECT k.new_topic AS topic, t.term, round(t.weight, 6) AS weight
FROM topic_terms t JOIN kept k USING (topic)"""))
def q_load_model(spark, sf):
    fx = fx_(spark, sf)
    path = scratch_path(spark, "model")
    save_model(fx.model, path, model_name=MODEL_NAME)
    m = open_model(spark, path, fx.topics)
    return m.topic_terms.select("topic", "term", r6("weight").alias("weight"))


# ------------------------------------------------------------------ windows / vectors
@register("rolling_month_mean", fixture_sql("""
, c AS (SELECT type_of_material, substr(pub_date, 1, 7) AS month, count(*) AS n FROM articles
  GROUP BY 1, 2),
b AS (SELECT type_of_material, min(month) AS lo, max(month) AS hi FROM c GROUP BY 1),
spine AS (SELECT type_of_material, strftime(CAST(m AS DATE), '%Y-%m') AS month FROM b,
  unnest(generate_series(CAST(lo || '-01' AS DATE), CAST(hi || '-01' AS DATE), INTERVAL 1 MONTH)) AS t(m)),
v AS (SELECT s.type_of_material, s.month, CAST(coalesce(c.n, 0) AS DOUBLE) AS value FROM spine s
  LEFT JOIN c USING (type_of_material, month))
SELECT month, type_of_material, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 6)
  AS value FROM v
WINDOW w AS (PARTITION BY type_of_material ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def q_rolling_month_mean(spark, sf):
    a = fx_(spark, sf).articles
    c = a.groupBy("type_of_material", D.month_key("pub_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    b = c.groupBy("type_of_material").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = b.select("type_of_material", F.explode(D.month_sequence_col(F.col("lo"), F.col("hi"), 0))
                     .alias("month"))
    v = spine.join(c, ["type_of_material", "month"], "left").select(
        "month", "type_of_material", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    out = rolling_month_mean(v, 3, "value", key="type_of_material")
    return out.select("month", "type_of_material", r6("value").alias("value"))


@register("l2_norm_per_doc", fixture_sql(
    "SELECT article_id, round(sqrt(sum(tfidf * tfidf)), 6) AS norm FROM doc_terms GROUP BY 1"))
def q_l2_norm_per_doc(spark, sf):
    n = l2_norm_per_doc(fx_(spark, sf).doc_terms)
    return n.select("article_id", r6("norm").alias("norm"))


@register("normalise_vector", fixture_sql("""
SELECT article_id, topic, round(weight / sum(weight) OVER (PARTITION BY article_id), 6) AS value
FROM dt WHERE article_id IN (SELECT article_id FROM dt GROUP BY 1 HAVING sum(weight) > 0)"""))
def q_normalise_vector(spark, sf):
    dt = fx_(spark, sf).doc_topics.filter(D.weights_sum("weights") > 0)
    return dt.select("article_id", F.posexplode(D.normalise_vector("weights")).alias("topic", "v")) \
        .select("article_id", "topic", r6("v").alias("value"))


@register("array_map_struct", fixture_sql("""
SELECT d.article_id, a.headline_main, round(d.weight, 6) AS first_weight,
  round(d3.weight, 6) AS topic3_weight
FROM dt d JOIN carts a USING (article_id) JOIN dt d3 ON d3.article_id = d.article_id AND d3.topic = 3
WHERE d.topic = 0"""))
def q_array_map_struct(spark, sf):
    fx = fx_(spark, sf)
    dt = fx.doc_topics.select("article_id", "weights",
                              F.map_from_entries(F.transform("weights", lambda v, i: F.struct(i, v)))
                              .alias("m"))
    return dt.join(fx.articles.select("article_id", "headline"), "article_id").select(
        "article_id", F.col("headline.main").alias("headline_main"),
        r6(F.element_at("weights", 1)).alias("first_weight"), r6(F.col("m")[3]).alias("topic3_weight"))


# ------------------------------------------------------------------ text features / scoring
@register("ngrams", fixture_sql(f"""
SELECT article_id, CAST(len({_ngram_expr('t', 1, 3)}) AS INTEGER) AS n_grams FROM toks"""))
def q_ngrams(spark, sf):
    c = corpus(fx_(spark, sf).articles)
    toks = c.select("article_id", vector_tokens("clean_text").alias("t"))
    return toks.select("article_id", F.size(ngrams("t", (1, 3))).alias("n_grams"))


@register("doc_word_count", fixture_sql(f"""
SELECT article_id, CAST({word_count_expr('clean_text')} AS INTEGER) AS n_words FROM corpus"""))
def q_doc_word_count(spark, sf):
    c = corpus(fx_(spark, sf).articles)
    return c.select("article_id", doc_word_count("clean_text").alias("n_words"))


@register("tfidf_transform", fixture_sql("""
SELECT article_id, term, round(tfidf, 6) AS tfidf FROM doc_terms
WHERE article_id IN (SELECT article_id FROM scorable)"""))
def q_tfidf_transform(spark, sf):
    fx = fx_(spark, sf)
    docs = fx.articles.filter(F.col("clean_text") != "")
    return tfidf_transform(docs, fx.tfidf).select("article_id", "term", r6("tfidf").alias("tfidf"))


@register("join_project_terms", fixture_sql("""
, has AS (SELECT DISTINCT article_id FROM doc_terms)
SELECT h.article_id, k.topic, round(coalesce(p.s, 0.0), 6) AS weight
FROM has h CROSS JOIN (SELECT CAST(range AS INTEGER) AS topic FROM range(8)) k
LEFT JOIN proj p ON p.article_id = h.article_id AND p.topic = k.topic"""))
def q_join_project_terms(spark, sf):
    fx = fx_(spark, sf)
    p = project_topics(fx.doc_terms, fx.model)
    return p.select("article_id", F.posexplode("weights").alias("topic", "w")).select(
        "article_id", "topic", r6("w").alias("weight"))


@register("project_topics", fixture_sql(
    "SELECT article_id, topic, round(raw, 6) AS weight FROM raw_dt"))
def q_project_topics(spark, sf):
    fx = fx_(spark, sf)
    dt = store_topic_weights(fx.articles, fx.model, MODEL_NAME, normalize="none")
    return dt.select("article_id", F.posexplode("weights").alias("topic", "w")).select(
        "article_id", "topic", r6("w").alias("weight"))


@register("score_missing", fixture_sql("""
SELECT d.article_id, d.topic, round(d.weight, 6) AS weight FROM dt d JOIN carts a USING (article_id)
WHERE NOT (a.pub_date < '2003')"""))
def q_score_missing(spark, sf):
    fx = fx_(spark, sf)
    early = fx.articles.filter(F.col("pub_date") < "2003").select("article_id")
    existing = fx.doc_topics.join(early, "article_id", "left_semi")
    new = store_topic_weights(fx.articles, fx.model, MODEL_NAME, "linear", existing=existing)
    return new.select("article_id", F.posexplode("weights").alias("topic", "w")).select(
        "article_id", "topic", r6("w").alias("weight"))


@register("filter_unscored", fixture_sql("""
SELECT article_id FROM carts WHERE clean_text IS NOT NULL AND clean_text <> ''
AND article_id NOT IN (SELECT d.article_id FROM dt d JOIN carts a USING (article_id)
                       WHERE a.pub_date < '2003')"""))
def q_filter_unscored(spark, sf):
    fx = fx_(spark, sf)
    early = fx.articles.filter(F.col("pub_date") < "2003").select("article_id")
    existing = fx.doc_topics.join(early, "article_id", "left_semi")
    return filter_unscored(fx.articles, existing, MODEL_NAME).select("article_id")


# ------------------------------------------------------------------ filters / projections
@register("filter_news_uncleaned", fixture_sql("""
SELECT article_id, web_url FROM articles
WHERE full_text IS NOT NULL AND full_text <> '' AND type_of_material = 'News'"""))
def q_filter_news_uncleaned(spark, sf):
    from ..sources.fixtures import load_articles
    return FL.filter_news_uncleaned(load_articles(spark, sf)).select("article_id", "web_url")


@register("filter_needs_body", fixture_sql("""
SELECT article_id FROM articles WHERE document_type = 'article'
AND type_of_material = 'News' AND failed_scrape IS NULL"""))
def q_filter_needs_body(spark, sf):
    from ..sources.fixtures import load_landed_articles
    return FL.filter_needs_body(load_landed_articles(spark, sf)).select("article_id")


@register("filter_date_range", fixture_sql("""
SELECT 'closed' AS form, article_id FROM articles WHERE pub_date >= '2001-10' AND pub_date <= '2001-11'
UNION ALL SELECT 'open', article_id FROM articles WHERE pub_date > '2001-09' AND pub_date < '2002-11'
UNION ALL SELECT 'half_open', article_id FROM articles WHERE pub_date >= '2002-01' AND pub_date < '2002-03'
"""))
def q_filter_date_range(spark, sf):
    a = fx_(spark, sf).articles
    parts = [FL.filter_date_range(a, lo, hi, form).select(F.lit(form).alias("form"), "article_id")
             for form, lo, hi in [("closed", "2001-10", "2001-11"), ("open", "2001-09", "2002-11"),
                                  ("half_open", "2002-01", "2002-03")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("filter_min_length", fixture_sql(f"""
SELECT article_id FROM carts WHERE clean_text IS NOT NULL AND {word_count_expr('clean_text')} >= 30"""))
def q_filter_min_length(spark, sf):
    return FL.filter_min_length(fx_(spark, sf).articles, 30).select("article_id")


@register("filter_scored_news", fixture_sql("""
SELECT DISTINCT a.article_id FROM carts a JOIN dt USING (article_id)
WHERE a.type_of_material = 'News' AND a.pub_date > '2001-09' AND a.pub_date < '2014-11'"""))
def q_filter_scored_news(spark, sf):
    fx = fx_(spark, sf)
    return FL.filter_scored_news(fx.articles, fx.doc_topics, MODEL_NAME, "2001-09", "2014-11",
                                 "open").select("article_id")


@register("filter_topic_keep", fixture_sql("""
SELECT topic, term, round(weight, 6) AS weight FROM topic_terms
WHERE topic IN (SELECT topic FROM topics WHERE keep)"""))
def q_filter_topic_keep(spark, sf):
    fx = fx_(spark, sf)
    return FL.filter_topic_keep(fx.topic_terms, fx.topics).select(
        "topic", "term", r6("weight").alias("weight"))


@register("filter_recent_days", fixture_sql("""
, mx AS (SELECT max(CAST(substr(pub_date, 1, 10) AS DATE)) AS d FROM carts)
SELECT article_id, pub_date FROM carts, mx
WHERE CAST(substr(pub_date, 1, 10) AS DATE) > mx.d - 7 AND CAST(substr(pub_date, 1, 10) AS DATE) <= mx.d"""))
def q_filter_recent_days(spark, sf):
    return FL.filter_recent_days(fx_(spark, sf).articles, 7).select("article_id", "pub_date")


@register("filter_ignore_urls", fixture_sql("""
SELECT article_id FROM articles WHERE NOT (starts_with(web_url, 'http://www.nytimes.com/video')
  OR starts_with(web_url, 'http://www.legacy.com') OR starts_with(web_url, 'http://www.nytimes.com/slideshow')
  OR starts_with(web_url, 'http://cooking.nytimes.com/recipes')
  OR starts_with(web_url, 'http://www.nytimes.com/interactive'))"""))
def q_filter_ignore_urls(spark, sf):
    return FL.filter_ignore_urls(fx_(spark, sf).articles).select("article_id")


@register("project_tooltip", fixture_sql("""
SELECT article_id, substr(pub_date, 1, 10) AS pub_date, lead_paragraph, headline_main, web_url
FROM articles"""))
def q_project_tooltip(spark, sf):
    t = FL.project_tooltip(fx_(spark, sf).articles)
    return t.select("article_id", "pub_date", "lead_paragraph",
                    F.col("headline.main").alias("headline_main"), "web_url")


@register("scan_clean_text", fixture_sql("""
SELECT article_id, clean_text FROM carts WHERE clean_text IS NOT NULL AND clean_text <> ''"""))
def q_scan_clean_text(spark, sf):
    return FL.scan_clean_text(fx_(spark, sf).articles)


# ------------------------------------------------------------------ scalar functions
@register("date_digits", fixture_sql(
    "SELECT article_id, replace(split_part(pub_date, 'T', 1), '-', '') AS digits FROM articles"))
def q_date_digits(spark, sf):
    return fx_(spark, sf).articles.select("article_id", D.date_digits("pub_date").alias("digits"))


@register("date_parts", fixture_sql("""
SELECT article_id, CAST(substr(d, 1, 4) AS INTEGER) AS y, CAST(substr(d, 5, 2) AS INTEGER) AS m,
  CAST(substr(d, 7) AS INTEGER) AS d
FROM (SELECT article_id, replace(split_part(pub_date, 'T', 1), '-', '') AS d FROM articles)"""))
def q_date_parts(spark, sf):
    a = fx_(spark, sf).articles.select("article_id", D.date_digits("pub_date").alias("s"))
    y, m, d = D.date_parts("s")
    return a.select("article_id", y.alias("y"), m.alias("m"), d.alias("d"))


@register("date_string", fixture_sql("""
SELECT article_id, CAST(y AS VARCHAR) || lpad(CAST(m AS VARCHAR), 2, '0')
  || lpad(CAST(d AS VARCHAR), 2, '0') AS ds
FROM (SELECT article_id, CAST(substr(pub_date, 1, 4) AS INTEGER) AS y,
  CAST(substr(pub_date, 6, 2) AS INTEGER) AS m, CAST(substr(pub_date, 9, 2) AS INTEGER) AS d
  FROM articles)"""))
def q_date_string(spark, sf):
    a = fx_(spark, sf).articles
    y, m, d = (F.substring("pub_date", 1, 4).cast("int"), F.substring("pub_date", 6, 2).cast("int"),
               F.substring("pub_date", 9, 2).cast("int"))
    return a.select("article_id", D.date_string(y, m, d).alias("ds"))


@register("month_key", fixture_sql(
    "SELECT article_id, substr(pub_date, 1, 7) AS month FROM articles"))
def q_month_key(spark, sf):
    return fx_(spark, sf).articles.select("article_id", D.month_key("pub_date").alias("month"))


@register("day_key", fixture_sql(
    "SELECT article_id, substr(pub_date, 1, 10) AS day FROM articles"))
def q_day_key(spark, sf):
    return fx_(spark, sf).articles.select("article_id", D.day_key("pub_date").alias("day"))


@register("next_month", fixture_sql("""
SELECT DISTINCT substr(pub_date, 1, 7) AS month,
  strftime(CAST(substr(pub_date, 1, 7) || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next
FROM articles"""))
def q_next_month(spark, sf):
    a = fx_(spark, sf).articles.select(D.month_key("pub_date").alias("month")).distinct()
    return a.select("month", D.next_month("month").alias("next"))


@register("month_sequence", fixture_sql("""
, b AS (SELECT min(substr(pub_date, 1, 7)) AS lo, max(substr(pub_date, 1, 7)) AS hi FROM articles)
SELECT strftime(CAST(m AS DATE), '%Y-%m') AS month FROM b, unnest(generate_series(
  CAST(lo || '-01' AS DATE), CAST(hi || '-01' AS DATE) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS t(m)"""))
def q_month_sequence(spark, sf):
    a = fx_(spark, sf).articles
    b = a.agg(F.min(D.month_key("pub_date")).alias("lo"), F.max(D.month_key("pub_date")).alias("hi"))
    return b.select(F.explode(D.month_sequence_col(F.col("lo"), F.col("hi"), 1)).alias("month"))


@register("shift_back_weeks", fixture_sql("""
SELECT DISTINCT substr(pub_date, 1, 7) AS month,
  CAST(last_day(CAST(substr(pub_date, 1, 7) || '-01' AS DATE)) - 42 AS DATE) AS label FROM articles"""))
def q_shift_back_weeks(spark, sf):
    a = fx_(spark, sf).articles.select(D.month_key("pub_date").alias("month")).distinct()
    return a.select("month", D.shift_back_weeks(D.month_start("month"), 3).alias("label"))


# ------------------------------------------------------------------ rollup
_ROLLUP_SQL = fixture_sql(f""",
r AS (SELECT d.*, a.type_of_material, substr(a.pub_date, 1, 7) AS month,
    row_number() OVER (PARTITION BY d.article_id ORDER BY rw DESC, topic DESC) AS place,
    row_number() OVER (PARTITION BY d.article_id ORDER BY rw DESC, topic) AS first_place
  FROM dt d JOIN carts a USING (article_id))
SELECT month, type_of_material, topic, count(*) AS n_docs, CAST(sum(CAST(place <= 3 AS INTEGER)) AS BIGINT) AS n_ranked,
  CAST(sum(CAST(first_place = 1 AS INTEGER)) AS BIGINT) AS n_best, CAST(sum(CAST(weight > 0.001 AS INTEGER)) AS BIGINT) AS n_over,
  CAST(sum(CAST(weight > 0.1 AS INTEGER)) AS BIGINT) AS n_strong, round(sum(weight), 6) AS weight_sum,
  arg_min(CASE WHEN weight > 0 THEN article_id END, (-rw, article_id)) AS best_id,
  round(max(CASE WHEN weight > 0 THEN weight END), 6) AS best_weight
FROM r GROUP BY ALL""")


def _rollup_rows(rollup):
    return rollup.select(*RU.KEYS, *RU.COUNTS, r6("weight_sum").alias("weight_sum"),
                         F.col("best.article_id").alias("best_id"), r6("best.weight").alias("best_weight"))


@register("topic_rollup", _ROLLUP_SQL)
def q_topic_rollup(spark, sf):
    fx = fx_(spark, sf)
    return _rollup_rows(RU.topic_rollup(fx.doc_topics, fx.articles))


@register("topic_rollup_increments", _ROLLUP_SQL)
def q_topic_rollup_increments(spark, sf):
    """The same rollup, merged from those of three periods that cut through months."""
    return _rollup_rows(_increments(spark, sf))


def _increments(spark, sf):
    fx = fx_(spark, sf)
    day = F.col("pub_date")
    parts = [day < "2002-06-17", (day >= "2002-06-17") & (day < "2003-03-09"), day >= "2003-03-09"]
    kept = None
    for own in parts:                       # each increment is merged into the stored rollup
        new = RU.topic_rollup(fx.doc_topics.where(own), fx.articles)
        path = write_table(new if kept is None else RU.merge_rollups(kept, new), "rollup")
        kept = spark.read.parquet(path)
    return kept


@register("empire_counts_rollup", ORACLE["empire_counts"])
def q_empire_counts_rollup(spark, sf):
    return RU.empire_counts_of(_increments(spark, sf), K)


@register("best_per_month_rollup", ORACLE["best_per_month"])
def q_best_per_month_rollup(spark, sf):
    return RU.best_per_month_of(_increments(spark, sf), K).select("month", "topic", "article_id", r6("weight").alias("weight"))


@register("smooth_trend_rollup", _trend_sql(ranked=True, normalize=True))
def q_smooth_trend_rollup(spark, sf):
    return smooth_trend_of(_increments(spark, sf), K, normalize=True).select("date", "topic", r6("value").alias("value"))
