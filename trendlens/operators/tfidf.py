"""Long-form TF-IDF: term statistics, vocabulary selection and the doc-term table.

Plan shape (one text shuffle): the (article_id, clean_text) projection is hash
partitioned by article_id once; n-gram explode, per-document term counts and the
per-document L2 norm then run inside those partitions with no further exchange.
Term statistics shuffle by term with map-side partial aggregation, so a term that
occurs in a third of all documents is combined before it moves. The vocabulary
is bounded by ``max_features``; only that bounded table is broadcast.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, vector_tokens
from ..session import BROADCAST_MAX_ROWS, ensure_checkpoint_dir, ship_package, shuffles_dropped, text_partitions, write_table
from .blocks import PACKED
from .grams import CHUNK_BUCKETS, COUNTS, blocks_of, bucket_counts, sum_counts, term_stats, weights_of, wide

# buckets of the candidate sketch: fewer cost a longer list of candidates, so there are
# more for a larger vocabulary; a task holds a long for each
BUCKETS, MOST_BUCKETS, BUCKETS_A_TERM = 1 << 18, 1 << 22, 64


@dataclass
class TfidfModel:
    """Vocabulary (term, term_id, df, ctf, idf) and the n-gram range it was fit with."""
    vocab: DataFrame
    ngram_range: tuple[int, int] = (1, 1)
    max_features: int | None = None


def partition_docs(docs: DataFrame, id_col: str = "article_id",
                   text_col: str = "clean_text") -> DataFrame:
    """(article_id, clean_text) hash-partitioned by article_id."""
    return (docs.select(F.col(id_col).alias("article_id"), F.col(text_col).alias("clean_text"))
            .repartition(text_partitions(docs.sparkSession), "article_id"))


def occurrences(docs_p: DataFrame, ngram_range=(1, 1)) -> DataFrame:
    """(article_id, term), a row per n-gram of every document."""
    # tokens are materialised as a column first: the n-gram lambda refers to them
    # once per position and must not re-run the tokenizer each time
    toks = docs_p.select("article_id", vector_tokens("clean_text").alias("toks"))
    return toks.select("article_id", F.explode(ngrams("toks", ngram_range)).alias("term"))


def term_frequencies(docs_p: DataFrame, ngram_range=(1, 1)) -> DataFrame:
    """(article_id, term, tf). ``docs_p`` must be partitioned by article_id so the
    count needs no shuffle."""
    return occurrences(docs_p, ngram_range).groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocab_term_weights(docs_p: DataFrame, model: "TfidfModel") -> DataFrame:
    """(article_id, term, w = tf * idf) for a frozen vocabulary. The broadcast
    vocabulary is joined right after the n-gram explode, so n-grams outside it
    are dropped before the per-document count instead of after."""
    toks = docs_p.select("article_id", vector_tokens("clean_text").alias("toks"))
    grams = toks.select("article_id", F.explode(ngrams("toks", model.ngram_range)).alias("term"))
    v = _maybe_broadcast(model.vocab.select("term", "idf"), model.max_features)
    return (grams.join(v, "term").groupBy("article_id", "term", "idf")
            .agg((F.count(F.lit(1)) * F.col("idf")).alias("w")).select("article_id", "term", "w"))


def sorted_texts(docs_p: DataFrame) -> DataFrame:
    """(article_id, clean_text) with the rows of an id side by side."""
    return (docs_p.where(F.col("clean_text").isNotNull()).sortWithinPartitions("article_id")
            .select("article_id", "clean_text"))


def _sendable(model: "TfidfModel") -> bool:
    """Whether the vocabulary may be sent to the documents, its n-grams as numbers."""
    bounded = model.max_features is not None and model.max_features <= BROADCAST_MAX_ROWS
    return bounded and (model.ngram_range[1] * model.max_features + 1) ** model.ngram_range[1] < 1 << 62


def tfidf_weights(docs_p: DataFrame, model: "TfidfModel") -> DataFrame:
    """(article_id, term, tfidf) with unit L2 norm per document for a frozen vocabulary.
    A vocabulary of bounded size is sent to the documents and looked up in Arrow batches;
    an unbounded one meets their n-grams in a join."""
    lo, hi = model.ngram_range
    if not _sendable(model):
        return l2_normalise(vocab_term_weights(docs_p, model))
    vocab = model.vocab.select("term", "term_id", "idf")
    sent = docs_p.sparkSession.sparkContext.broadcast(vocab.toArrow())     # max_features rows
    kind = dict(docs_p.dtypes)["article_id"]
    x = sorted_texts(docs_p).mapInArrow(weights_of(sent, lo, hi), f"article_id {kind}, term_id int, tfidf double")
    return x.join(F.broadcast(vocab.select("term_id", "term")), "term_id").select("article_id", "term", "tfidf")


def packed_weights(docs: DataFrame, model: "TfidfModel") -> tuple[DataFrame, np.ndarray] | None:
    """(``tfidf_weights`` of ``docs`` as ``blocks.PACKED``, idf by term_id), written to the
    shared folder: made from the sorted texts in one pass, so no entry becomes a row of its
    own. Every document with an id is in it. None where the vocabulary is not sent."""
    if not _sendable(model):
        return None
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    vocab = model.vocab.select("term", "term_id", "idf").toArrow().sort_by("term_id")          # max_features rows
    if not np.array_equal(vocab.column("term_id").to_numpy(), np.arange(vocab.num_rows)):
        return None
    lo, hi = model.ngram_range
    sent = spark.sparkContext.broadcast(vocab)
    with shuffles_dropped(spark):
        docs_p = partition_docs(docs)
        rows = sorted_texts(docs_p).mapInArrow(blocks_of(sent, lo, hi), PACKED.format(dict(docs_p.dtypes)["article_id"]))
        return spark.read.parquet(write_table(rows, "blocks")), vocab.column("idf").to_numpy()


def l2_normalise(x: DataFrame) -> DataFrame:
    """(article_id, term, tfidf) with unit L2 norm per document (partition-local
    when x is partitioned by article_id)."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("article_id")))
    return x.select("article_id", "term", (F.col("w") / norm).alias("tfidf"))


def term_df_ctf(tf: DataFrame) -> DataFrame:
    """(term, df, ctf): document frequency and corpus term frequency."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def corpus_stats(docs_p: DataFrame, ngram_range=(1, 1)) -> DataFrame:
    """``term_df_ctf(term_frequencies(docs_p))``, counted in Arrow batches: a chunk of
    documents sends each of its n-grams once. ``docs_p`` must be partitioned by article_id."""
    lo, hi = ngram_range
    if lo < 1 or hi < lo:
        raise ValueError(f"bad ngram_range {ngram_range}")
    rows = sorted_texts(docs_p).mapInArrow(term_stats(lo, hi), "term string, df long, ctf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def prune_max_df(stats: DataFrame, n_docs, max_df=0.8) -> DataFrame:
    """Drop terms with df > max_df (an int is a count, a float a fraction of n_docs)."""
    if isinstance(max_df, bool):
        raise TypeError("max_df must be int or float")
    if isinstance(max_df, int):
        return stats.filter(F.col("df") <= F.lit(max_df))
    return stats.filter(F.col("df") <= F.lit(float(max_df)) * n_docs)


def vocab_topk(stats: DataFrame, max_features: int | None) -> DataFrame:
    """Keep the ``max_features`` terms with highest ctf (ties: term ascending).

    A ctf histogram (one row per distinct ctf value) gives the cut-off value
    first, so the ordered top-k only sees terms at or above it instead of every
    distinct n-gram.
    """
    if max_features is None:
        return stats
    hist = stats.groupBy("ctf").agg(F.count(F.lit(1)).alias("n_terms"))
    cum = F.sum("n_terms").over(Window.orderBy(F.desc("ctf"))
                                .rowsBetween(Window.unboundedPreceding, 0))
    cut = (hist.withColumn("cum", cum).filter(F.col("cum") >= max_features)
           .agg(F.max("ctf").alias("cut")))
    cand = stats.filter(F.col("ctf") >= F.coalesce(cut.scalar(), F.lit(0)))
    return cand.orderBy(F.desc("ctf"), F.asc("term")).limit(max_features)


def buckets_for(max_features: int) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (BUCKETS_A_TERM * max_features - 1).bit_length()))


def candidate_stats(docs_p: DataFrame, n_docs, max_features: int, ngram_range=(1, 1), max_df=0.8,
                    buckets: int | None = None) -> DataFrame:
    """(term, df, ctf) of all terms that can be among the ``max_features`` most frequent
    after ``max_df``, with exact counts, stored.

    Occurrences are first counted by hash bucket, and a bucket's count is an upper bound for
    every term in it; the counts, a long a bucket, come to the driver. The terms
    of the fullest buckets are counted exactly; the last place among them bounds the
    cut-off from below, so buckets under it hold no member of the vocabulary. Terms
    of the other buckets are counted in a second pass, if there are any. N-grams are
    counted in Arrow batches (``grams.py``); none outside these buckets becomes a string
    or is shuffled."""
    spark = docs_p.sparkSession
    lo, hi = ngram_range
    buckets = buckets or buckets_for(max_features)
    texts = sorted_texts(docs_p)
    most = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(bucket_counts(lo, hi, buckets), COUNTS).groupBy("chunk").applyInArrow(sum_counts, COUNTS).collect():
        part = wide(r["counts"])
        most[r["chunk"] * CHUNK_BUCKETS:r["chunk"] * CHUNK_BUCKETS + len(part)] = part

    def exact(chosen: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(np.packbits(chosen))           # a bit a bucket
        tf = texts.mapInArrow(term_stats(lo, hi, buckets, sent), "term string, df long, ctf long")
        stats = tf.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
        return prune_max_df(stats, n_docs, max_df).checkpoint(eager=True)

    some = most[most > 0]
    first = min(2 * max_features, len(some))
    last = int(np.partition(some, -first)[-first]) if first else 0
    stats = exact((most >= last) & (most > 0))
    top = stats.orderBy(F.desc("ctf")).limit(max_features).agg(F.min("ctf").alias("m"), F.count("*").alias("n")).first()
    cut = top["m"] if top["n"] == max_features else 0
    rest = (most >= max(cut, 1)) & (most < last)
    return stats if not rest.any() else stats.unionByName(exact(rest))


def numbered_terms(vocab: DataFrame) -> DataFrame:
    """``vocab`` with term_id, the place of each term in ascending order, without
    bringing all terms to one task: ranges are numbered by themselves, and the sizes
    of the ranges before are added."""
    spark = vocab.sparkSession
    ranges = (vocab.repartitionByRange(text_partitions(spark), "term")
              .withColumn("range", F.spark_partition_id()).checkpoint(eager=True))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))    # a row per range
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("term")) - 1
    return (ranges.withColumn("own", own).join(F.broadcast(starts), "range")
            .withColumn("term_id", (F.col("start") + F.col("own")).cast("int")).drop("range", "start", "own"))


def with_idf(vocab: DataFrame, n_docs) -> DataFrame:
    """Smoothed idf ln((1+N)/(1+df)) + 1 and an alphabetical term_id, if there is none
    yet (in one task: for a vocabulary of bounded size)."""
    if "term_id" not in vocab.columns:
        vocab = vocab.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    return (vocab
            .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)
            .select("term", "term_id", "df", "ctf", "idf"))


def _maybe_broadcast(df: DataFrame, bound: int | None) -> DataFrame:
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_MAX_ROWS else df


def fit_vocab(tf: DataFrame, n_docs, max_features: int | None = 5000, max_df=0.8) -> DataFrame:
    """Vocabulary (term, term_id, df, ctf, idf) from per-document term counts."""
    stats = prune_max_df(term_df_ctf(tf), n_docs, max_df)
    return with_idf(vocab_topk(stats, max_features), n_docs)


def tfidf_fit(docs: DataFrame, max_features: int | None = 5000, ngram_range=(1, 1),
              max_df=0.8, id_col: str = "article_id",
              text_col: str = "clean_text", buckets: int | None = None) -> tuple[DataFrame, TfidfModel]:
    """Fit vocabulary + idf on ``docs`` and return (doc_terms, model).

    ``docs`` is every document of the fit (empty texts count in N). Like any
    estimator fit it runs jobs eagerly: the bucket counts, the statistics of the
    candidate terms and the vocabulary (<= max_features rows) are checkpointed to the
    shared folder; without ``max_features`` every term is a member and is counted.
    The returned doc-term table is lazy: it re-explodes the text over the same
    article_id partitions, keeps vocabulary n-grams before counting and
    normalises partition-locally — cheaper than shuffling materialised
    per-document counts, which are several times the text size."""
    ensure_checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):
        docs_p = partition_docs(docs, id_col, text_col)
        n_docs = F.lit(float(docs_p.count()))
        if max_features is None:
            stats = prune_max_df(corpus_stats(docs_p, ngram_range), n_docs, max_df)
            vocab = with_idf(numbered_terms(stats), n_docs).checkpoint(eager=True)
        else:
            stats = candidate_stats(docs_p, n_docs, max_features, ngram_range, max_df, buckets)
            vocab = with_idf(vocab_topk(stats, max_features), n_docs).checkpoint(eager=True)
    model = TfidfModel(vocab, tuple(ngram_range), max_features)
    return tfidf_weights(docs_p, model), model


def tfidf_transform(docs: DataFrame, model: TfidfModel, id_col: str = "article_id",
                    text_col: str = "clean_text") -> DataFrame:
    """TF-IDF of documents in a frozen vocabulary; unknown terms are dropped."""
    return tfidf_weights(partition_docs(docs, id_col, text_col), model)


def l2_norm_per_doc(doc_terms: DataFrame, value_col: str = "tfidf") -> DataFrame:
    """(article_id, norm) of each document row of X."""
    return doc_terms.groupBy("article_id").agg(
        F.sqrt(F.sum(F.col(value_col) * F.col(value_col))).alias("norm"))
