"""Stages of the corpus pipeline; each is (spark, docs, sf_dir) -> DataFrame."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import dartminhash, fmindex, pieces, secrets, toxicity
from .common import prepare, stored, table, with_hit
from .queries import tokenizer_file


ROW = "pipeline_row"


def numbered(docs):
    """The rows with a number of their own, written once so that it stays: ids may be
    null or repeat, and a verdict holds for one row only."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def texts_of(rows):
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def moved_and_kept(rows, gone):
    """Of ``rows``: those whose number may be a doc_id of ``gone``, which alone meet it in a
    join, and the others, whose texts stay where they are."""
    hit = with_hit(rows, ROW, gone, "doc_id")
    return hit.where("hit").drop("hit"), hit.where("not hit").drop("hit")


def without(rows, gone):
    """``rows`` less those whose number is a doc_id of ``gone``, numbers dropped."""
    gone = stored(gone.select("doc_id"), "pipeline-gone")
    moved, kept = moved_and_kept(rows, gone)
    return moved.join(gone.select(F.col("doc_id").alias(ROW)), ROW, "left_anti").unionByName(kept).select(
        [F.col(c) for c in rows.columns if c != ROW])


def drop_toxic(spark, docs, sf_dir):
    """Keep the rows whose text is not judged toxic; learns from ``labels``. Null and
    empty texts are judged as an empty text; a row with a null or repeated id has
    the verdict of its own text; an empty table gives an empty one."""
    prepare(spark)
    rows = numbered(docs)
    scored = toxicity.score_toxicity(rows, table(spark, sf_dir, "labels"), scored=texts_of(rows))
    return without(rows, toxicity.judged(scored).where("predicted = 1"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of near duplicates stays, that with the smallest id (a
    null id comes last; of rows with one id, any). Null and empty texts are one
    group; an empty table gives an empty one."""
    prepare(spark)
    rows = numbered(docs)
    found = stored(dartminhash.near_duplicates(texts_of(rows)).select("doc_id", "class_id").join(
        rows.select(F.col(ROW).alias("doc_id"), F.col("doc_id").cast("long").alias("id")), "doc_id"), "pipeline-classes")
    first = (found.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("class_id", F.col("first.doc_id").alias("kept")))
    return without(rows, found.join(first, "class_id").where("doc_id <> kept"))


def drop_contaminated(spark, docs, sf_dir):
    """Keep the rows in whose text no benchmark window occurs; null and empty texts
    stay, an empty benchmark drops nothing, an empty table gives an empty one."""
    prepare(spark)
    rows = numbered(docs)
    found = fmindex.find_contamination(texts_of(rows), table(spark, sf_dir, "benchmark"))
    return without(rows, found.where(F.size("spans") > 0))


def mask_secrets(spark, docs, sf_dir):
    """Replace every secret in the texts; ``n_chars`` follows. All rows stay, a null
    text stays null (``n_chars`` too), an empty table gives an empty one."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark, docs, sf_dir):
    """Ids and decoding digests of the remaining texts, one row each; a null text counts
    as empty, an empty table gives an empty one."""
    prepare(spark)
    return pieces.digests(pieces.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model")))
