"""Registered queries: NMF and the topic-model pipelines."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nmf import START_DIGITS, START_MOD, SWEEPS, nmf_fit, nmf_step
from ..operators.topic_stats import article_relevance
from ..sources.fixtures import FIXTURE_MAX_FEATURES, FIXTURE_TOPICS, build_fixture, corpus
from .catalog import register
from .oracle import fixture_sql
from .queries_core import r6
from .topics import article_relevance_w, final_topics, initial_topics, relevant_docs

# --- test-profile parameters -------------------------------------------------
TRAINING_WINDOW = ("2001-09-11", "2003-03-31")
RELEVANCE_QUANTILE = 0.25     # the least relevant quarter of the articles is left out
# ---------------------------------------------------------------------------

_K = FIXTURE_TOPICS


def _start_sql(key: str, k: str) -> str:
    """The hashed start of one entry."""
    return (f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':' || CAST({k} AS VARCHAR) || ':0'), 1, {START_DIGITS}))::BIGINT "
            f"% {START_MOD}) + 1) / {float(START_MOD)}")


_START_SQL = f""",
kspine AS (SELECT CAST(range AS INTEGER) AS topic FROM range({_K})),
W0 AS (SELECT d.article_id, k.topic, {_start_sql('d.article_id', 'k.topic')} AS w
  FROM (SELECT DISTINCT article_id FROM doc_terms) d CROSS JOIN kspine k),
H0 AS (SELECT v.term, k.topic, {_start_sql('v.term', 'k.topic')} AS h FROM vocab v CROSS JOIN kspine k),
XHt AS (SELECT x.article_id, h.topic, sum(x.tfidf * h.h) AS v FROM doc_terms x JOIN H0 h USING (term)
  GROUP BY 1, 2),
HHt AS (SELECT a.topic AS i, b.topic AS j, sum(a.h * b.h) AS g FROM H0 a JOIN H0 b USING (term)
  GROUP BY 1, 2),"""

_TERM_SQL = """,
WtX AS (SELECT x.term, w.topic, sum(x.tfidf * w.w) AS v FROM doc_terms x JOIN W1 w USING (article_id)
  GROUP BY 1, 2),
WtW AS (SELECT a.topic AS i, b.topic AS j, sum(a.w * b.w) AS g FROM W1 a JOIN W1 b USING (article_id)
  GROUP BY 1, 2),"""

_STEP_ROWS = """
SELECT 'H' AS kind, term AS key, topic, round(h, 6) AS value FROM H1
UNION ALL SELECT 'W', CAST(article_id AS VARCHAR), topic, round(w, 6) FROM W1"""

_NMF_STEP_SQL = fixture_sql(_START_SQL + """
WG AS (SELECT w.article_id, g.j AS topic, sum(w.w * g.g) AS v FROM W0 w JOIN HHt g ON g.i = w.topic
  GROUP BY 1, 2),
W1 AS (SELECT w.article_id, w.topic, w.w * coalesce(x.v, 0.0) / (g.v + 1e-12) AS w FROM W0 w
  JOIN WG g USING (article_id, topic) LEFT JOIN XHt x USING (article_id, topic))""" + _TERM_SQL + """
GH AS (SELECT h.term, g.j AS topic, sum(h.h * g.g) AS v FROM H0 h JOIN WtW g ON g.i = h.topic
  GROUP BY 1, 2),
H1 AS (SELECT h.term, h.topic, h.h * coalesce(x.v, 0.0) / (g.v + 1e-12) AS h FROM H0 h
  JOIN GH g USING (term, topic) LEFT JOIN WtX x USING (term, topic))""" + _STEP_ROWS)


def _sweeps_sql(name: str, start: str, key: str, value: str, product: str, gram: str, out: str) -> str:
    """CTEs of the column sweeps: one exact update of one column each, over rows whose K
    values, products and Gram rows are lists."""
    g = (f"{name}g AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(g ORDER BY j) AS r FROM {gram} GROUP BY i))")
    rows = (f"{name}0 AS (SELECT s.{key}, list(s.{value} ORDER BY s.topic) AS w, list(coalesce(p.v, 0.0) ORDER BY s.topic) AS p, "
            f"any_value({name}g.g) AS g FROM {start} s CROSS JOIN {name}g LEFT JOIN {product} p "
            f"ON p.{key} = s.{key} AND p.topic = s.topic GROUP BY s.{key})")
    steps = []
    for n in range(SWEEPS * _K):
        k = n % _K + 1
        new = (f"greatest(w[{k}] + (p[{k}] - list_dot_product(w, g[{k}])) / g[{k}][{k}], 0.0)")
        parts = [f"w[1:{k - 1}]" if k > 1 else "CAST([] AS DOUBLE[])", f"[{new}]", f"w[{k + 1}:{_K}]" if k < _K else "CAST([] AS DOUBLE[])"]
        steps.append(f"{name}{n + 1} AS MATERIALIZED (SELECT {key}, p, g, list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}) AS w "
                     f"FROM {name}{n})")
    last = (f"{out} AS (SELECT {key}, CAST(t - 1 AS INTEGER) AS topic, w[t] AS {value} FROM {name}{SWEEPS * _K}, "
            f"unnest(range(1, {_K + 1})) AS u(t))")
    return ",\n".join([g, rows, *steps, last])


_HALS_STEP_SQL = fixture_sql(_START_SQL + "\n" + _sweeps_sql("wc", "W0", "article_id", "w", "XHt", "HHt", "W1") + _TERM_SQL + "\n"
                             + _sweeps_sql("hc", "H0", "term", "h", "WtX", "WtW", "H1") + _STEP_ROWS)


@register("nmf_step", _NMF_STEP_SQL)
def q_nmf_step(spark, sf):
    """One multiplicative update of both factors."""
    return _step_rows(spark, sf, "mu")


@register("nmf_hals_step", _HALS_STEP_SQL)
def q_nmf_hals_step(spark, sf):
    """One alternation of exact column updates."""
    return _step_rows(spark, sf, "hals")


def _step_rows(spark, sf, solver):
    fx = build_fixture(spark, sf)
    W1, H1 = nmf_step(fx.doc_terms, fx.tfidf.vocab, _K, 0, FIXTURE_MAX_FEATURES, solver)
    w = W1.select(F.lit("W").alias("kind"), F.col("article_id").cast("string").alias("key"),
                  F.posexplode("w").alias("topic", "value"))
    h = H1.select(F.lit("H").alias("kind"), F.col("term").alias("key"),
                  F.posexplode("h").alias("topic", "value"))
    return w.unionByName(h).select("kind", "key", "topic", r6("value").alias("value"))


@register("nmf_fit")
def q_nmf_fit(spark, sf):
    """(iteration, objective) of a fit until it stops by itself."""
    fx = build_fixture(spark, sf)
    return nmf_fit(fx.doc_terms, fx.tfidf.vocab, _K, max_features=FIXTURE_MAX_FEATURES, docs=corpus(fx.articles)).history


def _initial(spark, sf):
    fx = build_fixture(spark, sf)
    pred = (F.col("pub_date") >= TRAINING_WINDOW[0]) & (F.col("pub_date") <= TRAINING_WINDOW[1])
    return fx, initial_topics(fx.articles, pred)


@register("initial_topics")
def q_initial_topics(spark, sf):
    _, (res, top, _) = _initial(spark, sf)
    return top


@register("final_topics")
def q_final_topics(spark, sf):
    fx, (res, _, _) = _initial(spark, sf)
    k = res.n_topics
    rel = spark.range(k).select(F.col("id").cast("int").alias("topic"),
                                (F.col("id") / float(k)).alias("relevance"))
    _, _, top = final_topics(fx.articles, article_relevance_w(res.W, rel), quantile=RELEVANCE_QUANTILE)
    return top


@register("final_topics_docs", fixture_sql(f""",
rel AS (SELECT r.article_id, sum(r.raw * t.relevance) AS value FROM raw_dt r JOIN topics t USING (topic) GROUP BY 1),
joined AS (SELECT c.article_id, c.clean_text, r.value FROM carts c JOIN rel r USING (article_id) WHERE c.clean_text IS NOT NULL)
SELECT article_id, clean_text, round(value, 6) AS relevance FROM joined
WHERE value >= (SELECT quantile_disc(value, {RELEVANCE_QUANTILE}) FROM joined)"""))
def q_final_topics_docs(spark, sf):
    """The articles that the final fit takes, by the fixed topic model's relevance."""
    fx = build_fixture(spark, sf)
    relevance = article_relevance(fx.raw_doc_topics, fx.topics).withColumnRenamed("value", "relevance")
    return relevant_docs(fx.articles, relevance, quantile=RELEVANCE_QUANTILE).withColumn("relevance", r6("relevance"))
