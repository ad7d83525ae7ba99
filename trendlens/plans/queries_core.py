"""Registered queries: text features, topic model scoring and trends."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.project import store_topic_weights
from ..operators.tfidf import tfidf_fit
from ..sources.fixtures import (FIXTURE_MAX_DF, FIXTURE_MAX_FEATURES, FIXTURE_NGRAMS,
                                FIXTURE_TOPICS, MODEL_NAME, build_fixture, corpus)
from .catalog import register
from .oracle import fixture_sql
from .trends import smooth_trend

R = 6  # decimals kept in compared doubles


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R)


# --------------------------------------------------------------------------- text
@register("clean_tokenize", fixture_sql("""
SELECT article_id, clean_text FROM carts WHERE clean_text IS NOT NULL"""))
def q_clean_tokenize(spark, sf):
    a = build_fixture(spark, sf).articles
    return a.filter(F.col("clean_text").isNotNull()).select("article_id", "clean_text")


@register("tfidf_fit", fixture_sql("""
SELECT article_id, term, round(tfidf, 6) AS tfidf FROM doc_terms"""))
def q_tfidf_fit(spark, sf):
    fx = build_fixture(spark, sf)
    doc_terms, _ = tfidf_fit(corpus(fx.articles), FIXTURE_MAX_FEATURES, FIXTURE_NGRAMS,
                             FIXTURE_MAX_DF)
    return doc_terms.select("article_id", "term", r6("tfidf").alias("tfidf"))


@register("vocab_topk", fixture_sql("""
SELECT term, term_id, df, ctf, round(idf, 6) AS idf FROM vocab"""))
def q_vocab_topk(spark, sf):
    fx = build_fixture(spark, sf)
    _, model = tfidf_fit(corpus(fx.articles), FIXTURE_MAX_FEATURES, FIXTURE_NGRAMS, FIXTURE_MAX_DF)
    v = model.vocab
    return v.select("term", "term_id", "df", "ctf", r6("idf").alias("idf"))


@register("store_topic_weights", fixture_sql("""
SELECT article_id, model_name, topic, round(weight, 6) AS weight FROM dt"""))
def q_store_topic_weights(spark, sf):
    fx = build_fixture(spark, sf)
    dt = store_topic_weights(fx.articles, fx.model, MODEL_NAME, normalize="linear")
    return (dt.select("article_id", "model_name", F.posexplode("weights").alias("topic", "weight"))
            .select("article_id", "model_name", "topic", r6("weight").alias("weight")))


# ------------------------------------------------------------------------- trends
def _trend_sql(ranked: bool, normalize: bool, interval: int = 3, rank_number: int = 3,
               threshold: float = .001, tail: str | None = None) -> str:
    """Trend SQL; with ``tail`` the trend becomes CTE ``trend`` followed by ``tail``."""
    start = f"2001-0{10 - interval}"
    if ranked:
        hits = f"""
ranked AS (SELECT article_id, topic FROM (
  SELECT article_id, topic, row_number() OVER (PARTITION BY article_id ORDER BY rw DESC, topic DESC) rn
  FROM dt) WHERE rn <= {rank_number}),"""
    else:
        hits = f"ranked AS (SELECT article_id, topic FROM dt WHERE weight > {threshold}),"
    value = f"CASE WHEN cnt = {interval} THEN v END"
    if normalize:
        value = (f"CASE WHEN cnt = {interval} AND tot_cnt = {interval} AND tv <> 0 THEN v / tv END")
    final = (f"SELECT CAST(last_day(mdate) - {14 * interval} AS DATE) AS date, topic, "
             f"round(coalesce({value}, 0.0), 6) AS value FROM rolled")
    if tail:
        final = f", trend AS ({final})\n{tail}"
        final = final.lstrip()
    return fixture_sql(f""",
scored AS (SELECT a.article_id, substr(a.pub_date, 1, 7) AS month FROM carts a
  WHERE a.type_of_material = 'News' AND a.pub_date > '{start}'
  AND a.article_id IN (SELECT article_id FROM dt)),
{hits}
hits AS (SELECT s.month, r.topic, count(*) AS n FROM ranked r JOIN scored s USING (article_id)
  GROUP BY 1, 2),
totals AS (SELECT month, count(*) AS total FROM scored GROUP BY 1),
bounds AS (SELECT min(month) AS lo, max(month) AS hi FROM scored),
months AS (SELECT CAST(m AS DATE) AS mdate, strftime(CAST(m AS DATE), '%Y-%m') AS month
  FROM bounds, unnest(generate_series(CAST(lo || '-01' AS DATE), CAST(hi || '-01' AS DATE),
  INTERVAL 1 MONTH)) AS t(m)),
spine AS (SELECT month, mdate, CAST(k.range AS INTEGER) AS topic FROM months
  CROSS JOIN range({FIXTURE_TOPICS}) k),
monthly AS (SELECT s.month, s.mdate, s.topic,
  CASE WHEN t.total IS NULL THEN NULL ELSE CAST(coalesce(h.n, 0) AS DOUBLE) END AS value,
  CAST(coalesce(t.total, 0) AS DOUBLE) AS total
  FROM spine s LEFT JOIN totals t USING (month) LEFT JOIN hits h USING (month, topic)),
rolled AS (SELECT mdate, topic, avg(value) OVER w AS v, count(value) OVER w AS cnt,
  avg(total) OVER w AS tv, count(total) OVER w AS tot_cnt FROM monthly
  WINDOW w AS (PARTITION BY topic ORDER BY month ROWS BETWEEN {interval - 1} PRECEDING AND CURRENT ROW))
{final}""")


def _trend(spark, sf, **kw):
    fx = build_fixture(spark, sf)
    t = smooth_trend(fx.doc_topics, fx.articles, fx.model.n_topics, **kw)
    return t.select("date", "topic", r6("value").alias("value"))


@register("smooth_trend_ranked", _trend_sql(ranked=True, normalize=False))
def q_smooth_trend_ranked(spark, sf):
    return _trend(spark, sf, ranked=True)


@register("smooth_trend_threshold", _trend_sql(ranked=False, normalize=False))
def q_smooth_trend_threshold(spark, sf):
    return _trend(spark, sf, ranked=False)


@register("smooth_trend_normalized", _trend_sql(ranked=True, normalize=True))
def q_smooth_trend_normalized(spark, sf):
    return _trend(spark, sf, ranked=True, normalize=True)

