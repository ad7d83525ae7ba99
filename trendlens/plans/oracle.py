"""DuckDB SQL for the correctness oracle.

``fixture_sql(body)`` prefixes a query with CTEs that rebuild, in SQL, the same
test-profile tables the Spark side writes: the article view, cleaning, 1-3-gram
TF-IDF with its vocabulary, the closed-form topic matrix and the doc-topic
weights. Rankings compare order keys (``functions.numbers``) on both sides.
"""
from __future__ import annotations

from ..functions.text import (ALL_STOPWORDS, CONTRACTION_SPLITS, NON_ASCII, PUNCTUATION,
                              VECTOR_TOKEN, WHITESPACE)
from ..functions.numbers import order_key_sql
from ..sources.fixtures import (FIXTURE_MAX_DF, FIXTURE_MAX_FEATURES, FIXTURE_NGRAMS,
                                FIXTURE_TOPICS, MODEL_NAME)

_STOP = ", ".join(f"'{w}'" for w in ALL_STOPWORDS)

# RE2 has no lookahead: one replacement per contraction split
_CONTRACTIONS = [(rf"\b({a})({b}) ", r"\1 \2 ") if (a, b) == ("wan", "na")
                 else (rf"\b({a})({b})\b", r"\1 \2") for a, b in CONTRACTION_SPLITS]


def clean_expr(col: str) -> str:
    s = (f"regexp_replace(lower(regexp_replace({col}, '{NON_ASCII}', ' ', 'g')), "
         f"'{PUNCTUATION}', '', 'g')")
    s = f"(' ' || {s} || ' ')"
    for pat, rep in _CONTRACTIONS:
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    return (f"array_to_string(list_filter(regexp_split_to_array({s}, '{WHITESPACE}'), "
            f"lambda t: t <> '' AND NOT list_contains([{_STOP}], t)), ' ')")


def word_count_expr(col: str) -> str:
    return f"(CASE WHEN {col} = '' THEN 0 ELSE len(string_split({col}, ' ')) END)"


def _ngram_expr(toks: str, lo: int, hi: int) -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(toks)
        else:
            parts.append(f"list_transform(range(0, len({toks}) - {n - 1}), "
                         f"lambda i: array_to_string({toks}[i + 1:i + {n}], ' '))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


ARTICLES_CTE = """
articles AS (
  SELECT doc_id AS article_id,
         'http://example.com/' || CAST(doc_id AS VARCHAR) AS web_url,
         strftime(date '2001-09-01' + CAST(doc_id * 37 % 1000 AS INTEGER), '%Y-%m-%d')
           || 'T00:00:00Z' AS pub_date,
         CASE source WHEN 'src16' THEN 'Op-Ed' WHEN 'src17' THEN 'Letter'
              WHEN 'src18' THEN 'Review' ELSE 'News' END AS type_of_material,
         CASE WHEN source = 'src19' THEN 'multimedia' ELSE 'article' END AS document_type,
         split_part(text, chr(10), 1) AS headline_main,
         split_part(text, chr(10), 1) AS lead_paragraph,
         text AS full_text,
         CAST(NULL AS BOOLEAN) AS failed_scrape
  FROM documents)"""


def _model_ctes() -> str:
    lo, hi = FIXTURE_NGRAMS
    return f"""
carts AS MATERIALIZED (
  SELECT a.*, CASE WHEN full_text IS NOT NULL AND full_text <> '' AND type_of_material = 'News'
                   THEN {clean_expr('full_text')} END AS clean_text
  FROM articles a),
corpus AS (SELECT article_id, clean_text FROM carts WHERE clean_text IS NOT NULL),
n_docs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM corpus),
toks AS (SELECT article_id, regexp_extract_all(clean_text, '{VECTOR_TOKEN}') AS t FROM corpus),
grams AS (SELECT article_id, unnest({_ngram_expr('t', lo, hi)}) AS term FROM toks),
tf AS MATERIALIZED (SELECT article_id, term, count(*) AS tf FROM grams GROUP BY article_id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tf GROUP BY term),
vocab0 AS (
  SELECT term, df, ctf FROM stats, n_docs WHERE df <= {FIXTURE_MAX_DF} * n
  ORDER BY ctf DESC, term ASC LIMIT {FIXTURE_MAX_FEATURES}),
vocab AS MATERIALIZED (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id,
         df, CAST(ctf AS BIGINT) AS ctf, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM vocab0, n_docs),
xw AS (SELECT tf.article_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term)),
doc_terms AS MATERIALIZED (
  SELECT article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS tfidf FROM xw),
topic_terms AS MATERIALIZED (
  SELECT CAST(article_id % {FIXTURE_TOPICS} AS INTEGER) AS topic, term, sum(tfidf) AS weight
  FROM doc_terms GROUP BY 1, 2),
topics AS (
  SELECT topic, 'topic_' || CAST(topic AS VARCHAR) AS name, topic <> {FIXTURE_TOPICS - 1} AS keep,
         topic / {float(FIXTURE_TOPICS)} AS relevance
  FROM (SELECT DISTINCT topic FROM topic_terms)),
scorable AS (
  SELECT article_id, clean_text, {word_count_expr('clean_text')} AS n_words
  FROM carts WHERE clean_text IS NOT NULL AND clean_text <> ''),
proj AS (
  SELECT d.article_id, t.topic, sum(d.tfidf * t.weight) AS s
  FROM doc_terms d JOIN topic_terms t USING (term) GROUP BY 1, 2),
raw_dt AS MATERIALIZED (
  SELECT s.article_id, k.topic, coalesce(p.s, 0.0) AS raw, s.n_words, s.clean_text
  FROM scorable s CROSS JOIN (SELECT CAST(range AS INTEGER) AS topic FROM range({FIXTURE_TOPICS})) k
  LEFT JOIN proj p ON p.article_id = s.article_id AND p.topic = k.topic),
dt AS (
  SELECT article_id, CAST(topic AS INTEGER) AS topic, raw / n_words AS weight,
         {order_key_sql('(raw / n_words)')} AS rw, '{MODEL_NAME}' AS model_name
  FROM raw_dt)"""


def fixture_sql(body: str) -> str:
    """Full SQL: fixture CTEs followed by ``body`` (which starts with a CTE list
    continuation ', name AS (...)' or directly with SELECT)."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return f"WITH {ARTICLES_CTE.strip()},{_model_ctes()}{sep}{body}"
