"""Registered queries: landing, upserts, body extraction, cleaning updates, sinks
and serving queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import date_digits, day_bounds, month_key
from ..functions.numbers import order_key_sql
from ..functions.text import VECTOR_TOKEN
from ..operators import ingest as IN
from ..operators import topic_stats as TS
from ..operators import topic_terms as TT
from ..operators.html import TEST_PROFILE_RULES, extract_body
from ..sources import sinks as SK
from ..session import scratch_path
from ..sources.buckets import BucketedArticles
from ..sources.fixtures import (FIXTURE_NGRAMS, MODEL_NAME, build_fixture, landed_records, load_articles,
                                load_landed_articles, pages_by_url)
from ..sources.tables import ARTICLE_SCHEMA, scan_pages
from ..plans import serve as SV
from .catalog import register
from .oracle import _ngram_expr, clean_expr, fixture_sql, word_count_expr
from .queries_core import _trend, _trend_sql, r6
from .queries_more import _TOPIC_SPINE, _months_sql, _top_terms_sql

ID_TYPE = ARTICLE_SCHEMA["article_id"].dataType
SHIFT = 10 ** 9      # ids of records that repeat a URL, and positions late in the batch
TABLE_BUCKETS = 16
SPLIT = "2003"   # articles published before this were ingested by an earlier run

# --- fixed test-profile corpus queries: (terms, begin yyyymmdd, end yyyymmdd) ---
# ',' separates alternative terms, '+' stands for a space inside a phrase.
CORPUS_QUERIES = [("thhe", "20010901", "20021231"), ("onen,ouen", "20020101", "20041231"),
                  ("the+of", "20010911", "20041031")]


def _landing(spark, articles):
    """Search results as JSON lines, read back with the fixed schema."""
    path = scratch_path(spark, "landing")
    landed_records(articles).write.json(path)
    return IN.read_landed(spark, path, ID_TYPE)


def _landed(spark, sf):
    return IN.land_articles(_landing(spark, load_articles(spark, sf)))


_LANDED_SQL = """,
landed AS (SELECT 'bucket-' || CAST(article_id // 100 AS VARCHAR) AS query,
  CAST((row_number() OVER (PARTITION BY article_id // 100 ORDER BY article_id) - 1) // 10 AS INTEGER) AS page,
  CAST((row_number() OVER (PARTITION BY article_id // 100 ORDER BY article_id) - 1) % 10 AS INTEGER) AS pos,
  article_id, web_url, pub_date, type_of_material, document_type, headline_main, lead_paragraph
  FROM articles)"""


# ------------------------------------------------------------------ sources
@register("land_articles", fixture_sql(_LANDED_SQL + """
SELECT * FROM landed"""))
def q_land_articles(spark, sf):
    return _landed(spark, sf).select(
        "query", "page", "pos", "article_id", "web_url", "pub_date", "type_of_material",
        "document_type", F.col("headline.main").alias("headline_main"), "lead_paragraph")


@register("land_articles_cursor", fixture_sql(_LANDED_SQL + """
SELECT query, replace(split_part(arg_max(pub_date, page * 100 + pos), 'T', 1), '-', '') AS last_date
FROM landed GROUP BY query"""))
def q_land_articles_cursor(spark, sf):
    return IN.ingest_cursor(_landed(spark, sf))


@register("union_pages", fixture_sql("""
, parts AS (SELECT CASE WHEN type_of_material = 'News' THEN 'news-' ELSE 'other-' END AS pre,
  article_id, type_of_material = 'News' AS news FROM articles),
ranked AS (SELECT pre || 'bucket-' || CAST(article_id // 100 AS VARCHAR) AS query,
  CAST((row_number() OVER (PARTITION BY news, article_id // 100 ORDER BY article_id) - 1) // 10
  AS INTEGER) AS page, article_id FROM parts)
SELECT query, page, count(*) AS n_docs FROM ranked GROUP BY 1, 2"""))
def q_union_pages(spark, sf):
    a = load_articles(spark, sf)
    landed = lambda own, pre: IN.land_articles(_landing(spark, a.filter(own))).withColumn(
        "query", F.concat(F.lit(pre), "query"))
    u = IN.union_pages(landed(F.col("type_of_material") == "News", "news-"), landed(F.col("type_of_material") != "News", "other-"))
    return u.groupBy("query", "page").agg(F.count(F.lit(1)).alias("n_docs"))


def _corpus_sql() -> str:
    ors = []
    for terms, begin, end in CORPUS_QUERIES:
        alts = " OR ".join(f"contains(lower(full_text), '{t.replace('+', ' ')}')"
                           for t in terms.split(","))
        ors.append(f"(({alts}) AND replace(split_part(pub_date, 'T', 1), '-', '') "
                   f"BETWEEN '{begin}' AND '{end}')")
    return fixture_sql("SELECT article_id FROM articles WHERE " + " OR ".join(ors))


def corpus_select(articles, queries=CORPUS_QUERIES, text_col: str = "full_text"):
    """Articles matching any (terms, begin, end) query: a term alternative occurs
    in the lower-cased text and the publication day is within [begin, end].
    The query list is a parameter, so the match is one pushed-down filter."""
    cond = F.lit(False)
    text = F.lower(F.col(text_col))
    day = date_digits("pub_date")
    for terms, begin, end in queries:
        alt = F.lit(False)
        for t in terms.split(","):
            alt = alt | text.contains(t.replace("+", " "))
        cond = cond | (alt & day.between(begin, end))
    if not queries:
        return articles.filter(cond)
    # the days that any query asks for, as bounds that reach the scan
    within = day_bounds("pub_date", min(q[1] for q in queries), max(q[2] for q in queries))
    return articles.filter(within & cond)


@register("corpus_select", _corpus_sql())
def q_corpus_select(spark, sf):
    return corpus_select(load_articles(spark, sf)).select("article_id")


@register("scan_pages", fixture_sql("SELECT page_id, url, html FROM pages"))
def q_scan_pages(spark, sf):
    return scan_pages(spark, sf)


# ------------------------------------------------------------------ upserts / dedupe
def _existing_and_batch(spark, sf):
    """The articles of an earlier run, and a batch: all articles in a given order, those
    of every seventh id once more under the same URL with another id, and every eleventh
    id with another URL."""
    a = load_articles(spark, sf)
    existing = a.filter(F.col("pub_date") < SPLIT)
    own = a.drop("full_text", "failed_scrape", "clean_text")
    batch = own.withColumn("batch_pos", F.col("article_id"))
    again = own.filter(F.col("article_id") % 7 == 0).withColumn("batch_pos", F.col("article_id") + SHIFT).withColumn(
        "article_id", F.col("article_id") + SHIFT)
    moved = own.filter(F.col("article_id") % 11 == 0).withColumn("batch_pos", F.col("article_id") + 2 * SHIFT).withColumn(
        "web_url", F.concat("web_url", F.lit("/moved")))
    return existing, batch.unionByName(again).unionByName(moved)


_BATCH_SQL = f""",
existing AS (SELECT * FROM articles WHERE pub_date < '{SPLIT}'),
batch AS (SELECT article_id, web_url, article_id AS batch_pos FROM articles
  UNION ALL SELECT article_id + {SHIFT}, web_url, article_id + {SHIFT} FROM articles WHERE article_id % 7 = 0
  UNION ALL SELECT article_id, web_url || '/moved', article_id + {2 * SHIFT} FROM articles WHERE article_id % 11 = 0),
firsts AS (SELECT web_url, arg_min(article_id, batch_pos) AS article_id, min(batch_pos) AS batch_pos FROM batch GROUP BY 1),
fresh AS (SELECT * FROM firsts WHERE web_url NOT IN (SELECT web_url FROM existing)),
lasts AS (SELECT article_id, arg_max(web_url, batch_pos) AS web_url FROM fresh GROUP BY 1)"""


_UPSERT_SQL = fixture_sql(_BATCH_SQL + """
SELECT article_id, web_url, md5(full_text) AS text_md5 FROM existing WHERE article_id NOT IN (SELECT article_id FROM lasts)
UNION ALL SELECT article_id, web_url, md5('') FROM lasts""")


def _snapshot_rows(snapshot):
    return snapshot.select("article_id", "web_url", F.md5(F.col("full_text").cast("binary")).alias("text_md5"))


@register("upsert_articles", _UPSERT_SQL)
def q_upsert_articles(spark, sf):
    snap, _ = IN.upsert_articles(*_existing_and_batch(spark, sf))
    return _snapshot_rows(snap)


@register("upsert_articles_ignored", fixture_sql(_BATCH_SQL + """
SELECT DISTINCT b.article_id FROM batch b LEFT JOIN (SELECT f.article_id, f.batch_pos FROM fresh f JOIN lasts USING (article_id, web_url)) l
  ON b.article_id = l.article_id AND b.batch_pos = l.batch_pos WHERE l.article_id IS NULL"""))
def q_upsert_articles_ignored(spark, sf):
    return IN.upsert_articles(*_existing_and_batch(spark, sf))[1]


@register("upsert_articles_buckets", _UPSERT_SQL)
def q_upsert_articles_buckets(spark, sf):
    """The same upsert into a bucketed table, of which only touched buckets are written."""
    existing, batch = _existing_and_batch(spark, sf)
    table = BucketedArticles.create(existing, scratch_path(spark, "articles"), TABLE_BUCKETS)
    return _snapshot_rows(table.upsert(batch)[0].read())


@register("anti_join_new", fixture_sql(_BATCH_SQL + """
SELECT article_id, web_url, batch_pos FROM batch WHERE web_url NOT IN (SELECT web_url FROM existing)"""))
def q_anti_join_new(spark, sf):
    existing, batch = _existing_and_batch(spark, sf)
    return IN.anti_join_new(batch, existing).select("article_id", "web_url", "batch_pos")


@register("semi_join_known", fixture_sql(_BATCH_SQL + """
SELECT DISTINCT article_id FROM batch WHERE web_url IN (SELECT web_url FROM existing)"""))
def q_semi_join_known(spark, sf):
    existing, batch = _existing_and_batch(spark, sf)
    return IN.semi_join_known(batch, existing)


@register("semi_join_in_table", fixture_sql(_BATCH_SQL + """
SELECT article_id, web_url, batch_pos FROM batch WHERE web_url IN (SELECT web_url FROM existing)"""))
def q_semi_join_in_table(spark, sf):
    existing, batch = _existing_and_batch(spark, sf)
    return IN.semi_join_in_table(batch, existing).select("article_id", "web_url", "batch_pos")


# ------------------------------------------------------------------ bodies
# The test pages hold one article of <p> elements. One that is not closed has all text up
# to the article's end, as later elements nest inside it. Every third page comes twice
# under one URL, the second time without its text.
_PLAIN = "replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
_PAGES = f""",
ps AS (SELECT page_id AS article_id, string_split(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '<p>') AS p FROM pages),
body AS MATERIALIZED (SELECT article_id, array_to_string(list_transform(range(2, len(p) + 1), lambda j: {_PLAIN.format(
    "(CASE WHEN contains(p[j], '</p>') THEN split_part(p[j], '</p>', 1) ELSE array_to_string(p[j:len(p)], '') END)")}), ' ') AS body
  FROM ps)"""


def _pages(spark, sf):
    pages = pages_by_url(scan_pages(spark, sf))
    again = pages.filter(F.crc32("web_url") % 3 == 0).withColumn("html", F.lit("<html></html>"))
    return pages.unionByName(again)


@register("extract_body", fixture_sql(_PAGES + """
SELECT 'http://example.com/' || CAST(article_id AS VARCHAR) AS web_url, 'article_p' AS rule, body FROM body"""))
def q_extract_body(spark, sf):
    return extract_body(pages_by_url(scan_pages(spark, sf)), TEST_PROFILE_RULES).select("web_url", "rule", "body")


@register("join_body", fixture_sql(_PAGES + """
SELECT a.article_id, b.body FROM articles a LEFT JOIN body b USING (article_id)"""))
def q_join_body(spark, sf):
    articles = load_articles(spark, sf)
    return IN.join_body(articles, IN.bodies_of(articles, _pages(spark, sf), TEST_PROFILE_RULES)).select("article_id", "body")


def _update_sql(elig_where: str) -> str:
    return fixture_sql(_PAGES + f""",
elig AS (SELECT article_id FROM articles WHERE {elig_where})
SELECT a.article_id,
  CASE WHEN e.article_id IS NOT NULL THEN coalesce(b.body, '') ELSE '' END AS full_text,
  CASE WHEN e.article_id IS NOT NULL AND coalesce(b.body, '') = '' THEN true
       ELSE a.failed_scrape END AS failed_scrape
FROM articles a LEFT JOIN elig e USING (article_id) LEFT JOIN body b USING (article_id)""")


_UPDATE_SQL = _update_sql("document_type = 'article' AND type_of_material = 'News' AND failed_scrape IS NULL")


@register("update_bodies", _UPDATE_SQL)
def q_update_bodies(spark, sf):
    u = IN.update_bodies(load_landed_articles(spark, sf), _pages(spark, sf), TEST_PROFILE_RULES)
    return u.select("article_id", "full_text", "failed_scrape")


@register("update_bodies_buckets", _UPDATE_SQL)
def q_update_bodies_buckets(spark, sf):
    """The same update of a bucketed table."""
    table = BucketedArticles.create(load_landed_articles(spark, sf), scratch_path(spark, "articles"), TABLE_BUCKETS)
    return table.update_bodies(_pages(spark, sf), TEST_PROFILE_RULES).read().select("article_id", "full_text", "failed_scrape")


@register("update_bodies_batch", _update_sql(f"pub_date >= '{SPLIT}'"))
def q_update_bodies_batch(spark, sf):
    landed = load_landed_articles(spark, sf)
    u = IN.update_bodies_batch(landed, landed.filter(F.col("pub_date") >= SPLIT), _pages(spark, sf), TEST_PROFILE_RULES)
    return u.select("article_id", "full_text", "failed_scrape")


# ------------------------------------------------------------------ cleaning updates
@register("clean_missing", fixture_sql("SELECT article_id, clean_text FROM carts"))
def q_clean_missing(spark, sf):
    return IN.clean_missing(load_articles(spark, sf)).select("article_id", "clean_text")


@register("clean_batch", fixture_sql(f"""
SELECT article_id, CASE WHEN pub_date >= '{SPLIT}' THEN {clean_expr('full_text')} END AS clean_text
FROM articles"""))
def q_clean_batch(spark, sf):
    a = load_articles(spark, sf)
    batch = a.filter(F.col("pub_date") >= SPLIT).select("article_id")
    return IN.clean_batch(a, batch).select("article_id", "clean_text")


# ------------------------------------------------------------------ joins on results
_BEST_CTE = """,
best AS (SELECT topic, rank, article_id, weight FROM (SELECT d.article_id, d.topic, d.weight,
  CAST(row_number() OVER (PARTITION BY d.topic ORDER BY d.rw DESC, d.article_id) AS INTEGER) AS rank
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.type_of_material = 'News' AND a.pub_date > '2001-09' AND a.pub_date < '2014-11')
  WHERE rank <= 25)"""


@register("join_best_metadata", fixture_sql(_BEST_CTE + """
SELECT b.topic, b.rank, b.article_id, a.pub_date, a.web_url, a.headline_main
FROM best b JOIN carts a USING (article_id)"""))
def q_join_best_metadata(spark, sf):
    fx = build_fixture(spark, sf)
    j = SK.join_best_metadata(TS.best_overall(fx.doc_topics, fx.articles), fx.articles)
    return j.select("topic", "rank", "article_id", "pub_date", "web_url",
                    F.col("headline.main").alias("headline_main"))


@register("join_topic_names", _trend_sql(True, False, tail="""
SELECT t.date, t.topic, n.name, t.value FROM trend t JOIN topics n USING (topic)"""))
def q_join_topic_names(spark, sf):
    fx = build_fixture(spark, sf)
    return TT.join_topic_names(_trend(spark, sf, ranked=True), fx.topics).select(
        "date", "topic", "name", "value")


# ------------------------------------------------------------------ sinks
_WIDE = "SELECT date, " + ", ".join(
    f"coalesce(max(CASE WHEN topic = {k} THEN value END), 0.0) AS topic_{k}" for k in range(8)) + \
    " FROM trend GROUP BY date"


def _wide(spark, sf):
    fx = build_fixture(spark, sf)
    path = scratch_path(spark, "trend") + ".csv"
    wide = SK.sink_trend_csv(_trend(spark, sf, ranked=True), fx.topics, path)
    return SK.read_csv(spark, path, wide.schema)


@register("sink_trend_csv", _trend_sql(True, False, tail=_WIDE))
def q_sink_trend_csv(spark, sf):
    return _wide(spark, sf)


@register("sink_empire_csv", fixture_sql(f""",
inr AS (SELECT d.article_id, d.topic, d.rw, substr(a.pub_date, 1, 7) AS month
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.pub_date >= '2001-10' AND a.pub_date < '2014-12'),
mx AS (SELECT article_id, max(rw) AS m FROM inr GROUP BY 1),
best AS (SELECT i.article_id, any_value(i.month) AS month, min(i.topic) AS topic
  FROM inr i JOIN mx USING (article_id) WHERE i.rw = mx.m GROUP BY 1),
c AS (SELECT month, topic, count(*) AS n FROM best GROUP BY 1, 2),
grid AS (SELECT m.month, k.topic, coalesce(c.n, 0) AS n
  FROM {_months_sql('2001-10', '2014-12')} m CROSS JOIN {_TOPIC_SPINE} k
  LEFT JOIN c ON c.month = m.month AND c.topic = k.topic)
SELECT month AS date, """ + ", ".join(
    f'max(CASE WHEN topic = {k} THEN n END) AS "{k}"' for k in range(8)) + """
FROM grid GROUP BY month"""))
def q_sink_empire_csv(spark, sf):
    fx = build_fixture(spark, sf)
    path = scratch_path(spark, "empire") + ".csv"
    counts = TS.empire_counts(fx.doc_topics, fx.articles, n_topics=fx.model.n_topics)
    return SK.read_csv(spark, path, SK.sink_empire_csv(counts, fx.model.n_topics, path).schema)


def _best_json(spark, sf):
    fx = build_fixture(spark, sf)
    path = scratch_path(spark, "best") + ".json"
    SK.sink_best_json(TS.best_overall(fx.doc_topics, fx.articles), fx.articles, fx.topics, path)
    return SK.read_best_json(spark, path)


_BEST_FLAT = _BEST_CTE + """
SELECT t.name, b.rank, substr(a.pub_date, 1, 10) AS pub_date, a.lead_paragraph, a.headline_main,
  a.web_url FROM best b JOIN carts a USING (article_id) JOIN topics t USING (topic)"""


@register("sink_best_json", fixture_sql(_BEST_FLAT))
def q_sink_best_json(spark, sf):
    j = _best_json(spark, sf)
    return j.select("name", F.posexplode("articles").alias("pos", "a")).select(
        "name", (F.col("pos") + 1).alias("rank"), "a.pub_date", "a.lead_paragraph",
        F.col("a.headline.main").alias("headline_main"), "a.web_url")


_BPM_CTE = """,
bpm_in AS (SELECT d.article_id, d.topic, d.weight, d.rw, substr(a.pub_date, 1, 7) AS month
  FROM dt d JOIN carts a USING (article_id)
  WHERE a.type_of_material = 'News' AND a.pub_date >= '2001-09' AND a.pub_date < '2014-12'
    AND d.weight > 0),
bpm AS (SELECT month, topic, article_id, weight FROM (SELECT *, row_number() OVER
  (PARTITION BY month, topic ORDER BY rw DESC, article_id) AS rn FROM bpm_in) WHERE rn = 1),
wsum AS (SELECT article_id, sum(weight) AS ws FROM dt GROUP BY 1)"""


def _best_month_json(spark, sf):
    fx = build_fixture(spark, sf)
    bpm = TS.best_per_month(fx.doc_topics, fx.articles, n_topics=fx.model.n_topics)
    path = scratch_path(spark, "best-month") + ".json"
    SK.sink_best_month_json(bpm, fx.articles, fx.doc_topics, fx.topics, path)
    return path


@register("sink_best_month_json", fixture_sql(_BPM_CTE + """
SELECT t.name, b.month, b.article_id AS _id, round(b.weight, 6) AS weight,
  round(w.ws, 6) AS weights_sum, substr(a.pub_date, 1, 10) AS pub_date, a.web_url
FROM bpm b JOIN carts a USING (article_id) JOIN wsum w USING (article_id) JOIN topics t USING (topic)"""))
def q_sink_best_month_json(spark, sf):
    j = SK.read_best_json(spark, _best_month_json(spark, sf), SK.month_entry(ID_TYPE))
    return j.select("name", F.explode("articles").alias("a")).select(
        "name", month_key("a.pub_date").alias("month"), "a._id", r6("a.weight").alias("weight"),
        r6("a.weights_sum").alias("weights_sum"), "a.pub_date", "a.web_url")


@register("filter_best_json", fixture_sql(_BPM_CTE + """,
kept AS (SELECT t.name, b.month, b.article_id AS _id, b.weight FROM bpm b JOIN carts a USING (article_id)
  JOIN topics t USING (topic) WHERE b.weight >= 0.001)
SELECT t.name, k.month, k._id, round(k.weight, 6) AS weight FROM topics t LEFT JOIN kept k USING (name)"""))
def q_filter_best_json(spark, sf):
    path = scratch_path(spark, "filtered") + ".json"
    SK.filter_best_json(_best_month_json(spark, sf), .001, spark, ID_TYPE, path)
    f = SK.read_best_json(spark, path, SK.month_entry(ID_TYPE))
    return f.select("name", F.explode_outer("articles").alias("a")).select(
        "name", month_key("a.pub_date").alias("month"), "a._id", r6("a.weight").alias("weight"))


def _terms_json(spark, sf):
    fx = build_fixture(spark, sf)
    concise = TT.topic_concise_terms(TT.topic_top_terms(fx.topic_terms, 30), 10)
    path = scratch_path(spark, "terms") + ".json"
    SK.sink_topic_terms_json(concise, fx.topics, path)
    return SK.read_object(spark, path, "string", value="terms")


_TERMS_CTE = _top_terms_sql(30) + f""",
concise AS (SELECT topic, rank, term FROM (SELECT topic, term, CAST(row_number() OVER
  (PARTITION BY topic ORDER BY {order_key_sql('pct')} DESC, term DESC) AS INTEGER) AS rank FROM top_terms)
  WHERE rank <= 10),
terms_json AS (SELECT t.name, string_agg(c.term, ', ' ORDER BY c.rank) AS terms
  FROM concise c JOIN topics t USING (topic) WHERE t.keep GROUP BY t.name)"""


@register("sink_topic_terms_json", fixture_sql(_TERMS_CTE + "\nSELECT name, terms FROM terms_json"))
def q_sink_topic_terms_json(spark, sf):
    return _terms_json(spark, sf)


@register("sink_daily_counts_json", fixture_sql("""
, days AS (SELECT CAST(d AS DATE) AS d FROM unnest(generate_series(DATE '2001-09-01',
    DATE '2004-05-31', INTERVAL 1 DAY)) AS t(d)),
c AS (SELECT CAST(substr(pub_date, 1, 10) AS DATE) AS d, count(*) AS n FROM articles GROUP BY 1)
SELECT strftime(days.d, '%Y%m%d') AS day, coalesce(c.n, 0) AS n FROM days LEFT JOIN c USING (d)"""))
def q_sink_daily_counts_json(spark, sf):
    path = scratch_path(spark, "days") + ".json"
    SK.sink_daily_counts_json(TS.daily_counts(build_fixture(spark, sf).articles, "20010831", "20040531"), path)
    return SK.read_object(spark, path, "bigint", "day", "n")


# ------------------------------------------------------------------ serving
KEPT_NAMES = [f"topic_{k}" for k in range(7)]
LOOKUP_NAMES = ["topic_0", "topic_3"]


def _kept_names(spark, sf):
    t = build_fixture(spark, sf).topics
    return [r["name"] for r in t.filter("keep").orderBy("topic").collect()]


@register("trend_extent", _trend_sql(True, False, tail="""
SELECT min(date) AS min_date, max(date) AS max_date FROM trend"""))
def q_trend_extent(spark, sf):
    return SV.trend_extent(_wide(spark, sf))


@register("trend_melt", _trend_sql(True, False, tail=f", wide AS ({_WIDE})\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, date, {n} AS value FROM wide" for n in KEPT_NAMES)))
def q_trend_melt(spark, sf):
    return SV.trend_melt(_wide(spark, sf), _kept_names(spark, sf))


@register("trend_max", _trend_sql(True, False, tail=f", wide AS ({_WIDE})\n"
                                  f"SELECT max(greatest({', '.join(KEPT_NAMES)})) AS max_value FROM wide"))
def q_trend_max(spark, sf):
    return SV.trend_max(_wide(spark, sf), _kept_names(spark, sf))


@register("trend_stack_max", _trend_sql(True, False, tail=f", wide AS ({_WIDE})\n"
                                        f"SELECT round(max({' + '.join(KEPT_NAMES)}), 6) AS max_total FROM wide"))
def q_trend_stack_max(spark, sf):
    return SV.trend_stack_max(_wide(spark, sf), _kept_names(spark, sf)).select(
        r6("max_total").alias("max_total"))


@register("articles_flatten", fixture_sql(_BEST_CTE + """
SELECT t.name, CAST(b.rank - 1 AS INTEGER) AS pos, b.rank, substr(a.pub_date, 1, 10) AS pub_date,
  a.lead_paragraph, a.headline_main, a.web_url
FROM best b JOIN carts a USING (article_id) JOIN topics t USING (topic) WHERE t.keep"""))
def q_articles_flatten(spark, sf):
    f = SV.articles_flatten(_best_json(spark, sf), _kept_names(spark, sf))
    return f.select("name", "pos", (F.col("pos") + 1).alias("rank"), "pub_date", "lead_paragraph",
                    F.col("headline.main").alias("headline_main"), "web_url")


@register("topic_terms_lookup", fixture_sql(_TERMS_CTE + f"""
SELECT name, terms FROM terms_json WHERE name IN ({', '.join(f"'{n}'" for n in LOOKUP_NAMES)})"""))
def q_topic_terms_lookup(spark, sf):
    return SV.topic_terms_lookup(_terms_json(spark, sf), LOOKUP_NAMES)



# ------------------------------------------------------------------ streaming
@register("stream_ingest", fixture_sql(_PAGES + f""",
got AS MATERIALIZED (SELECT a.article_id, a.type_of_material = 'News' AS news, coalesce(b.body, '') AS full_text
  FROM articles a LEFT JOIN body b USING (article_id)),
cleaned AS MATERIALIZED (SELECT article_id, full_text, CASE WHEN full_text = '' THEN true END AS failed_scrape,
  CASE WHEN news AND full_text <> '' THEN {clean_expr('full_text')} END AS clean_text FROM got),
own AS (SELECT article_id, regexp_extract_all(clean_text, '{VECTOR_TOKEN}') AS t FROM cleaned WHERE clean_text <> ''),
own_tf AS (SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest({_ngram_expr('t', *FIXTURE_NGRAMS)}) AS term FROM own)
  GROUP BY 1, 2),
own_w AS (SELECT article_id, term, tf * idf AS w FROM own_tf JOIN vocab USING (term)),
own_x AS (SELECT article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS tfidf FROM own_w),
own_s AS (SELECT article_id, sum(tfidf * weight) AS s FROM own_x JOIN topic_terms USING (term) GROUP BY 1)
SELECT c.article_id, c.full_text, c.failed_scrape, c.clean_text, CASE WHEN c.clean_text <> '' THEN
  round(coalesce(s.s, 0.0) / {word_count_expr('c.clean_text')}, 6) END AS weights_sum
FROM cleaned c LEFT JOIN own_s s USING (article_id)"""))
def q_stream_ingest(spark, sf):
    """Search results that Spark wrote from the articles stream in, some of them twice, a
    file a micro-batch; the article table and the weights that the job wrote."""
    from ..streaming.ingest import stream_ingest, write_landing
    fx = build_fixture(spark, sf)
    records = landed_records(load_articles(spark, sf))
    again = records.filter(F.col("article_id") % 5 == 0).withColumn("query", F.concat(F.lit("z"), "query"))
    landing = write_landing(records.unionByName(again), scratch_path(spark, "landing"))
    out, ckpt = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-ckpt")
    q = stream_ingest(spark, landing, _pages(spark, sf), fx.model, out, ckpt,
                      MODEL_NAME, TEST_PROFILE_RULES, max_files_per_trigger=1, id_type=ID_TYPE)
    q.awaitTermination()
    weights = TS.weights_sum(spark.read.parquet(f"{out}/doc_topics")).withColumnRenamed("value", "weights_sum")
    return spark.read.parquet(f"{out}/articles").join(weights, "article_id", "left").select(
        "article_id", "full_text", "failed_scrape", "clean_text", r6("weights_sum").alias("weights_sum"))
