"""Test-profile views derived from the driver tables (the ``documents`` table has
no dates or article types, so they are derived by formula).

The same definitions exist as SQL in ``trendlens.plans.oracle`` so the DuckDB
oracle sees identical inputs.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import clean_missing
from ..functions.text import doc_word_count
from ..operators.project import (TopicModel, load_model, normalise_weights, scorable,
                                 score_terms)
from ..operators.tfidf import (TfidfModel, candidate_stats, partition_docs, tfidf_weights, vocab_topk,
                              with_idf)
from ..session import spread_if_narrow, write_table
from .tables import ARTICLE_SCHEMA, DERIVED, read_table

# --- fixed test-profile parameters ------------------------------------------
FIXTURE_MAX_FEATURES = 5000
FIXTURE_NGRAMS = (1, 3)
FIXTURE_MAX_DF = 0.8
FIXTURE_TOPICS = 8
MODEL_NAME = "fixture"
# ---------------------------------------------------------------------------


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Article records derived from ``documents`` (dates, types, URL, headline)."""
    d = F.col("doc_id")
    day = F.date_add(F.lit("2001-09-01").cast("date"), ((d * 37) % 1000).cast("int"))
    source = F.col("source")
    return documents.select(
        d.alias("article_id"),
        F.concat(F.lit("http://example.com/"), d.cast("string")).alias("web_url"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("pub_date"),
        F.when(source == "src16", "Op-Ed").when(source == "src17", "Letter").when(source == "src18", "Review")
        .otherwise("News").alias("type_of_material"),
        F.when(F.col("source") == "src19", "multimedia").otherwise("article").alias("document_type"),
        F.struct(F.substring_index(F.col("text"), "\n", 1).alias("main")).alias("headline"),
        F.substring_index(F.col("text"), "\n", 1).alias("lead_paragraph"),
        F.col("text").alias("full_text"),
        F.lit(None).cast("boolean").alias("failed_scrape"),
        F.lit(None).cast("string").alias("clean_text"),
    )


def load_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(read_table(spark, sf_dir, "documents"))


def load_landed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as they are landed, before any body is fetched."""
    return load_articles(spark, sf_dir).withColumn("full_text", F.lit(""))


def pages_by_url(pages: DataFrame) -> DataFrame:
    """Pages keyed by the article URL they belong to (page_id -> article_id)."""
    return pages.select(F.concat(F.lit("http://example.com/"), F.col("page_id").cast("string"))
                        .alias("web_url"), "html")


def corpus(articles: DataFrame) -> DataFrame:
    """Documents of the model fit: every article with a clean text ('' included)."""
    return articles.filter(F.col("clean_text").isNotNull()).select("article_id", "clean_text")


def fixed_topic_terms(doc_terms: DataFrame, n_topics: int = FIXTURE_TOPICS) -> DataFrame:
    """Closed-form H: topic = article_id % n_topics, weight = sum of tfidf."""
    return (doc_terms.groupBy((F.col("article_id") % n_topics).cast("int").alias("topic"), "term")
            .agg(F.sum("tfidf").alias("weight")))


def topics_table(topic_terms: DataFrame) -> DataFrame:
    """(topic, name, keep, relevance) — one row per topic present in H."""
    t = topic_terms.select("topic").distinct()
    return t.select("topic", F.concat(F.lit("topic_"), F.col("topic").cast("string")).alias("name"),
                    (F.col("topic") != FIXTURE_TOPICS - 1).alias("keep"),
                    (F.col("topic") / F.lit(float(FIXTURE_TOPICS))).alias("relevance"))


@dataclass
class Fixture:
    """The stage tables of ``sf_dir``. Each is written to a fresh scratch folder when it is
    first asked for, from those before it, which it reads back from storage; a query
    pays for no stage that it does not use."""
    spark: SparkSession
    sf_dir: str
    paths: dict[str, str]

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.paths:
            self.paths[name] = write_table(build(), name)
        return self.spark.read.parquet(self.paths[name])

    @property
    def articles(self) -> DataFrame:
        """Cleaned article snapshot."""
        return self._stored("articles", lambda: clean_missing(spread_if_narrow(load_articles(self.spark, self.sf_dir))))

    @property
    def tfidf(self) -> TfidfModel:
        def vocab():
            docs_p = partition_docs(corpus(self.articles))
            n_docs = F.lit(float(docs_p.count()))
            stats = candidate_stats(docs_p, n_docs, FIXTURE_MAX_FEATURES, FIXTURE_NGRAMS, FIXTURE_MAX_DF)
            return with_idf(vocab_topk(stats, FIXTURE_MAX_FEATURES), n_docs)
        return TfidfModel(self._stored("vocab", vocab), FIXTURE_NGRAMS, FIXTURE_MAX_FEATURES)

    @property
    def doc_terms(self) -> DataFrame:
        """(article_id, term, tfidf)"""
        return self._stored("doc_terms", lambda: tfidf_weights(partition_docs(corpus(self.articles)), self.tfidf))

    @property
    def topic_terms(self) -> DataFrame:
        """(topic, term, weight)"""
        return self._stored("topic_terms", lambda: fixed_topic_terms(self.doc_terms))

    @property
    def topics(self) -> DataFrame:
        """(topic, name, keep, relevance)"""
        return topics_table(self.topic_terms)

    @property
    def model(self) -> TopicModel:
        return load_model(self.tfidf, self.topic_terms, n_topics=FIXTURE_TOPICS)

    def _scored(self) -> DataFrame:
        def raw():
            spine = scorable(self.articles).select("article_id", doc_word_count("clean_text").alias("n_words"),
                                                   "pub_date", "type_of_material")
            return (score_terms(self.doc_terms, spine, self.model, MODEL_NAME, normalize="none")
                    .join(spine.select("article_id", "n_words"), "article_id"))
        return self._stored("raw_n_words", raw)

    @property
    def raw_doc_topics(self) -> DataFrame:
        """``doc_topics`` with normalize='none'."""
        return self._stored("raw_doc_topics", lambda: self._scored().drop("n_words"))

    @property
    def doc_topics(self) -> DataFrame:
        """(article_id, model_name, weights, record columns), 'linear' weights."""
        return self._stored("doc_topics", lambda: self._scored().select(
            "article_id", "model_name",
            normalise_weights(F.col("weights"), F.col("n_words"), "linear").alias("weights"),
            "pub_date", "type_of_material"))


# Paths of written tables per (application, sf_dir); another application builds its own.
_TABLES: dict[tuple[str, str], dict[str, str]] = {}


def build_fixture(spark: SparkSession, sf_dir: str, reuse: bool = True) -> Fixture:
    """The test-profile tables, built by this application's code in fresh folders
    and shared inside this application only; ``reuse=False`` builds them anew."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if not reuse or key not in _TABLES:
        _TABLES[key] = {}
    return Fixture(spark, sf_dir, _TABLES[key])


def landed_records(articles: DataFrame, bucket: int = 100) -> DataFrame:
    """The articles as search results land (``landed_schema``): one query a hundred ids,
    records in id order."""
    query = F.concat(F.lit("bucket-"), F.floor(F.col("article_id") / bucket).cast("long").cast("string"))
    own = Window.partitionBy("query")
    return articles.withColumn("query", query).select(
        "query", F.count(F.lit(1)).over(own).alias("hits"),
        (F.row_number().over(own.orderBy("article_id")) - 1).cast("long").alias("position"),
        *(f.name for f in ARTICLE_SCHEMA.fields if f.name not in DERIVED))
