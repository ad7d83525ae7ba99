"""Scoring documents against a topic-term matrix: weights = x . H^T.

H is kept as one row per term holding its K topic weights, so the product is a
join on term and a per-document sum of K columns. Documents stay partitioned by
article_id from the single text shuffle; the bounded H (vocabulary x K) is the
only broadcast side.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_word_count
from ..session import broadcast_small, text_partitions
from .blocks import BROADCAST_BYTES, DocBlocks, pack_docs
from .tfidf import TfidfModel, tfidf_weights

# K above which the per-topic sums use the vector aggregate instead of K columns
WIDE_K = 64
# Article columns stored next to the weights (the weights live on the record), so
# trend / ranking queries filter the doc-topic table without joining articles.
RECORD_COLUMNS = ("pub_date", "type_of_material")


def with_record_columns(doc_topics: DataFrame, articles: DataFrame, cols) -> DataFrame:
    """doc_topics with the article columns ``cols``: taken from doc_topics when
    stored there, else joined from ``articles`` on article_id."""
    cols = list(cols)
    if all(c in doc_topics.columns for c in cols):
        return doc_topics
    dt = doc_topics.drop(*[c for c in cols if c in doc_topics.columns])
    return dt.join(articles.select("article_id", *cols), "article_id")


@dataclass
class TopicModel:
    tfidf: TfidfModel
    topic_terms: DataFrame      # (topic, term, weight), topics dense 0..n_topics-1
    n_topics: int


def topic_matrix(topic_terms: DataFrame, n_topics: int) -> DataFrame:
    """(term, h array<double>[n_topics]) with 0.0 where a topic lacks the term."""
    m = topic_terms.groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "weight"))).alias("m"))
    return m.select("term", F.transform(F.sequence(F.lit(0), F.lit(n_topics - 1)),
                                        lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("h"))


def _bounded(model: TopicModel) -> bool:
    """Whether H, as rows of K numbers, may be broadcast."""
    mf = model.tfidf.max_features
    return mf is not None and mf * max(model.n_topics, 1) * 8 <= BROADCAST_BYTES


def project_topics(doc_terms: DataFrame, model: TopicModel) -> DataFrame:
    """(article_id, weights) = sum over terms of tfidf * h; documents without any
    vocabulary term have no row here (see ``store_topic_weights`` for the spine).
    Where H is too large to broadcast, X is packed and multiplied by term blocks."""
    k = model.n_topics
    if model.tfidf.max_features is not None and not _bounded(model):
        return project_blocks(doc_terms, model)
    h = topic_matrix(model.topic_terms, k)
    h = F.broadcast(h) if _bounded(model) else h
    x = doc_terms.join(h, "term")
    if k <= WIDE_K:
        agg = F.array(*[F.sum(F.col("h")[i] * F.col("tfidf")) for i in range(k)])
    else:
        agg = vector_to_array(Summarizer.sum(array_to_vector(F.col("h")), F.col("tfidf")))
    return x.groupBy("article_id").agg(agg.alias("weights"))


def project_blocks(doc_terms: DataFrame, model: TopicModel) -> DataFrame:
    """``project_topics`` by the blocked product: H (terms x K, a model parameter) goes
    out in term blocks, a task holds one of them at a time."""
    terms = model.tfidf.vocab.select("term", "term_id")
    size = terms.agg(F.max("term_id")).first()[0]
    h = np.zeros((0 if size is None else size + 1, model.n_topics))
    for r in model.topic_terms.join(terms, "term").select("term_id", "topic", "weight").toLocalIterator():
        h[r["term_id"], r["topic"]] = r["weight"]
    x = DocBlocks(pack_docs(doc_terms, terms, max_features=model.tfidf.max_features), len(h))
    out = x.rows(x.run(h, lambda _, y: y, transposed=False), "weights")
    x.close()
    return out


def join_relevance(docs: DataFrame, relevance: DataFrame) -> DataFrame:
    """(article_id, clean_text, relevance): inner join of texts and relevances by id."""
    return docs.select("article_id", "clean_text").join(
        relevance.select("article_id", F.col("relevance").cast("double").alias("relevance")), "article_id")


def normalise_weights(weights, n_words, normalize: str = "linear"):
    if normalize == "linear":
        return F.transform(weights, lambda w: w / n_words)
    if normalize == "sqrt":
        return F.transform(weights, lambda w: w / F.sqrt(n_words))
    if normalize in ("none", None):
        return weights
    raise ValueError(f"unknown normalize mode {normalize!r}")


def scorable(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("clean_text").isNotNull() & (F.col("clean_text") != ""))


def store_topic_weights(articles: DataFrame, model: TopicModel, model_name: str = "model",
                        normalize: str = "linear", min_doc_length: int | None = None,
                        existing: DataFrame | None = None) -> DataFrame:
    """doc_topics(article_id, model_name, weights) for every article with a
    non-empty clean text (and, given ``existing`` doc_topics, no weights yet for
    this model). Weights are divided by the word count ('linear'), its square
    root ('sqrt') or left as is ('none'). Zero vectors are kept."""
    docs = scorable(articles)
    if existing is not None:
        docs = filter_unscored(docs, existing, model_name)
    carry = [c for c in RECORD_COLUMNS if c in docs.columns]
    docs = docs.select("article_id", "clean_text",
                       doc_word_count("clean_text").alias("n_words"), *carry)
    if min_doc_length is not None:
        docs = docs.filter(F.col("n_words") >= min_doc_length)
    docs_p = docs.repartition(text_partitions(docs.sparkSession), "article_id")
    x = tfidf_weights(docs_p, model.tfidf)
    return score_terms(x, docs_p.select("article_id", "n_words", *carry), model, model_name,
                       normalize)


def score_terms(doc_terms: DataFrame, docs: DataFrame, model: TopicModel, model_name: str = "model",
                normalize: str = "linear") -> DataFrame:
    """doc_topics from an existing doc-term table; ``docs`` (article_id, n_words,
    optional record columns) is the document spine, so documents without
    vocabulary terms get zeros. Record columns (publication date, type) are
    carried onto the weights, as the weights live on the article record."""
    proj = project_topics(doc_terms, model)
    zeros = F.array_repeat(F.lit(0.0), model.n_topics)
    out = docs.join(proj, "article_id", "left")
    w = normalise_weights(F.coalesce(F.col("weights"), zeros), F.col("n_words"), normalize)
    carry = [c for c in RECORD_COLUMNS if c in docs.columns]
    return out.select("article_id", F.lit(model_name).alias("model_name"), w.alias("weights"),
                      *carry)


def filter_unscored(articles: DataFrame, doc_topics: DataFrame, model_name: str) -> DataFrame:
    """Articles with clean text and no weights for ``model_name`` yet."""
    done = doc_topics.filter(F.col("model_name") == model_name).select("article_id")
    return scorable(articles).join(done, "article_id", "left_anti")


def doc_topics_long(doc_topics: DataFrame) -> DataFrame:
    """(article_id, topic, weight) — one row per document and topic."""
    return doc_topics.select("article_id", F.posexplode("weights").alias("topic", "weight"))


def load_model(tfidf: TfidfModel, topic_terms: DataFrame, topics: DataFrame | None = None,
               n_topics: int | None = None) -> TopicModel:
    """Keep only topics whose ``keep`` flag is true and re-index them densely
    0..K'-1 in topic order. ``topics`` has at most K rows (a model parameter)."""
    if topics is None:
        if n_topics is None:
            n_topics = int(topic_terms.agg(F.max("topic")).first()[0]) + 1
        return TopicModel(tfidf, topic_terms, n_topics)
    kept = (topics.filter(F.col("keep")).select("topic")
            .withColumn("new_topic", (F.row_number().over(Window.orderBy("topic")) - 1).cast("int")))
    n_kept = kept.count()
    tt = (topic_terms.join(broadcast_small(kept), "topic")
          .select(F.col("new_topic").alias("topic"), "term", "weight"))
    return TopicModel(tfidf, tt, n_kept)
