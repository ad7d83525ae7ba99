"""Topic-model pipelines: TF-IDF -> NMF -> topic terms, then relevance filter and refit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_relevant
from ..operators.nmf import NMFResult, nmf_fit
from ..operators.project import join_relevance
from ..operators.tfidf import TfidfModel, packed_weights, tfidf_fit
from ..operators.topic_stats import article_relevance
from ..operators.topic_terms import topic_top_terms

QUANTILE_ACCURACY = 100_000     # of the quantile sketch: ranks are off by at most rows / this


def _docs(articles: DataFrame, predicate: Column | None) -> DataFrame:
    a = articles.filter(F.col("clean_text").isNotNull())
    if predicate is not None:
        a = a.filter(predicate)
    return a.select("article_id", "clean_text")


def initial_topics(articles: DataFrame, predicate: Column | None = None, max_features: int = 20000,
                   ngram_range=(1, 3), max_df=.8, n_topics: int = 30, n_top_words: int = 30,
                   max_iter: int = 200, tol: float = 1e-4, seed: int = 0
                   ) -> tuple[NMFResult, DataFrame, TfidfModel]:
    """TF-IDF -> NMF on the selected articles; returns (nmf, topic_top_terms, tfidf).

    W has a row for every selected article, of zeros for one without vocabulary
    terms. Without articles all tables are empty."""
    docs = _docs(articles, predicate)
    doc_terms, tf = tfidf_fit(docs, max_features, ngram_range, max_df)
    res = nmf_fit(doc_terms, tf.vocab, n_topics, max_iter, tol, seed, max_features, docs=docs, packed=packed_weights(docs, tf))
    return res, topic_top_terms(res.topic_terms(), n_top_words), tf


def article_relevance_w(W: DataFrame, relevance: DataFrame) -> DataFrame:
    """(article_id, relevance) = W . relevance vector (topic, relevance)."""
    return article_relevance(W.withColumnRenamed("w", "weights"), relevance).withColumnRenamed("value", "relevance")


def relevance_cut(relevance: DataFrame, quantile: float) -> float | None:
    """The relevance at ``quantile`` of the articles (a mergeable sketch, one row to the
    driver); None without articles. NMF leaves the scale of W free, so a cut by rank
    means the same for every model, which an absolute one does not."""
    if not 0 <= quantile <= 1:
        raise ValueError("quantile must be in 0..1")
    return relevance.agg(F.percentile_approx(F.col("relevance").cast("double"), quantile, QUANTILE_ACCURACY)).first()[0]


def relevant_docs(articles: DataFrame, relevance: DataFrame, threshold: float | None = None,
                  quantile: float | None = None, predicate: Column | None = None) -> DataFrame:
    """(article_id, clean_text, relevance) of the selected articles at or above
    ``threshold``, or above the relevance that ``quantile`` of them do not exceed."""
    if (threshold is None) == (quantile is None):
        raise ValueError("give a threshold or a quantile")
    docs = join_relevance(_docs(articles, predicate), relevance)
    if threshold is None:
        threshold = relevance_cut(docs, quantile)
        if threshold is None:
            return docs.limit(0)
    return filter_relevant(docs, threshold)


def final_topics(articles: DataFrame, relevance: DataFrame, threshold: float | None = None,
                 predicate: Column | None = None, max_features: int = 50000, ngram_range=(1, 3),
                 max_df=.8, n_topics: int = 20, n_top_words: int = 30, max_iter: int = 200,
                 tol: float = 1e-4, seed: int = 0, quantile: float | None = None
                 ) -> tuple[TfidfModel, NMFResult, DataFrame]:
    """Inner-join article relevance with the selected articles, keep the relevant ones
    (``relevant_docs``), refit TF-IDF and NMF; returns (tfidf, nmf, topic_top_terms).
    If no article is relevant all tables are empty."""
    docs = relevant_docs(articles, relevance, threshold, quantile, predicate).select("article_id", "clean_text")
    doc_terms, tf = tfidf_fit(docs, max_features, ngram_range, max_df)
    res = nmf_fit(doc_terms, tf.vocab, n_topics, max_iter, tol, seed, max_features, docs=docs, packed=packed_weights(docs, tf))
    return tf, res, topic_top_terms(res.topic_terms(), n_top_words)
