"""Landing, de-duplication (upsert by URL / id), body attachment and cleaning.

Table updates are expressed as joins producing a new snapshot; nothing is
updated in place. De-duplication groups by URL with ``min_by`` (partial
aggregation), so a URL repeated across a third of a batch is combined map-side
rather than sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_digits
from ..functions.text import clean_tokenize
from ..sources.tables import ARTICLE_SCHEMA, DERIVED, landed_schema
from .filters import filter_needs_body
from .html import DEFAULT_RULES, extract_body

ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]


PAGE_SIZE = 10                 # results a page of the search


def read_landed(spark: SparkSession, path: str, id_type: T.DataType = T.StringType()) -> DataFrame:
    """Landed search results (JSON lines) with a fixed schema."""
    return spark.read.schema(landed_schema(id_type)).json(path)


def land_articles(landed: DataFrame, max_pages: int = 10) -> DataFrame:
    """(query, page, pos, article columns) of the landed records that the pager takes: the
    pages 0 .. min(max_pages - 1, hits // 10) of each query."""
    pages = F.least(F.lit(max_pages).cast("long"), F.floor(F.col("hits") / PAGE_SIZE).cast("long") + 1)
    kept = landed.where(F.col("position") < pages * PAGE_SIZE)
    return kept.select("query", F.floor(F.col("position") / PAGE_SIZE).cast("int").alias("page"),
                       (F.col("position") % PAGE_SIZE).cast("int").alias("pos"),
                       *(c for c in ARTICLE_COLUMNS if c not in DERIVED))


def ingest_cursor(landed: DataFrame) -> DataFrame:
    """(query, last_date): yyyymmdd of the last record of the highest page landed."""
    return landed.groupBy("query").agg(
        date_digits(F.max_by("pub_date", F.struct("page", "pos"))).alias("last_date"))


def union_pages(*pages: DataFrame) -> DataFrame:
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def first_per_url(batch: DataFrame, order_col: str = "batch_pos") -> DataFrame:
    """The first record (lowest ``order_col``) of each web_url in a batch."""
    cols = [c for c in batch.columns if c != "web_url"]
    first = batch.groupBy("web_url").agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("r"))
    return first.select("web_url", "r.*").select(*batch.columns)


def anti_join_new(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Batch records whose web_url is not yet in the table."""
    return batch.join(articles.select("web_url"), "web_url", "left_anti")


def semi_join_known(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct ids of batch records whose web_url is already in the table."""
    return (batch.join(articles.select("web_url"), "web_url", "left_semi")
            .select("article_id").distinct())


def semi_join_in_table(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Batch records present in the table by web_url."""
    return batch.join(articles.select("web_url"), "web_url", "left_semi")


def new_articles(existing: DataFrame, batch: DataFrame, order_col: str = "batch_pos") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, ignored ids): batch records with a new web_url (first per URL
    wins), with an empty body; of several new URLs under one id the last in the batch stays."""
    first = first_per_url(batch, order_col)
    new = anti_join_new(first, existing)
    cols = [c for c in new.columns if c != "article_id"]
    last = (new.groupBy("article_id").agg(F.max_by(F.struct(*cols), F.struct(order_col, "web_url")).alias("r"))
            .select("article_id", "r.*"))
    rows = last.select(
        *[(F.lit("").alias(c) if c == "full_text"
           else F.lit(None).cast(ARTICLE_SCHEMA[c].dataType).alias(c)
           if c in ("failed_scrape", "clean_text") else F.col(c))
          for c in ARTICLE_COLUMNS])
    ignored = (batch.select("article_id", order_col)
               .join(last.select("article_id", order_col), ["article_id", order_col], "left_anti")
               .select("article_id").distinct())
    return rows, ignored


def upsert_articles(existing: DataFrame, batch: DataFrame,
                    order_col: str = "batch_pos") -> tuple[DataFrame, DataFrame]:
    """Insert the new records of a batch (``new_articles``); an existing record with the
    same id is replaced whole. Returns (articles snapshot, ignored ids)."""
    rows, ignored = new_articles(existing, batch, order_col)
    kept = existing.select(*ARTICLE_COLUMNS).join(rows.select("article_id"), "article_id", "left_anti")
    return kept.unionByName(rows), ignored


def one_body_per_url(bodies: DataFrame) -> DataFrame:
    """(web_url, body): a URL that several pages have keeps one body, the last in text
    order, so any body wins over an empty one."""
    return bodies.groupBy("web_url").agg(F.max("body").alias("body"))


def join_body(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Left join extracted bodies (web_url, body) onto articles, one a URL."""
    return articles.join(one_body_per_url(bodies), "web_url", "left")


def bodies_of(wanted: DataFrame, pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(web_url, body) for the URLs of ``wanted``: pages (web_url, html) nobody asks for
    are dropped before they are parsed."""
    asked = pages.join(wanted.select("web_url").distinct(), "web_url", "left_semi")
    return one_body_per_url(extract_body(asked, rules))


def _body_changes(eligible: DataFrame, source: DataFrame, rules) -> DataFrame:
    """(article_id, body) of eligible rows; '' where there is no body."""
    bodies = bodies_of(eligible, source, rules) if "html" in source.columns else one_body_per_url(source)
    return eligible.select("article_id", "web_url").join(bodies, "web_url", "left").select(
        "article_id", F.coalesce("body", F.lit("")).alias("body"))


def with_bodies(articles: DataFrame, changes: DataFrame, how: str = "left") -> DataFrame:
    """Articles with full_text (non-empty body) or failed_scrape=true set by
    ``changes`` (article_id, body); ``how="inner"`` gives the changed rows only."""
    out = articles.join(changes, "article_id", how)
    got = F.col("body").isNotNull() & (F.col("body") != "")
    missed = F.col("body").isNotNull() & (F.col("body") == "")
    return out.select(
        *[F.when(got, F.col("body")).otherwise(F.col(c)).alias(c) if c == "full_text"
          else F.when(missed, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "failed_scrape"
          else F.col(c) for c in ARTICLE_COLUMNS])


def update_bodies(articles: DataFrame, source: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Attach bodies to every article still needing one (see filter_needs_body).
    ``source`` holds bodies (web_url, body) or pages (web_url, html) to extract them from."""
    return with_bodies(articles, _body_changes(filter_needs_body(articles), source, rules))


def update_bodies_batch(articles: DataFrame, batch: DataFrame, source: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Attach bodies for a batch: table rows whose web_url is in the batch."""
    eligible = articles.join(batch.select("web_url"), "web_url", "left_semi")
    return with_bodies(articles, _body_changes(eligible, source, rules))


def clean_missing(articles: DataFrame, overwrite: bool = False) -> DataFrame:
    """Add clean_text to News rows with a body that lack it (all such rows when
    ``overwrite``). Single pass: a conditional projection, no join."""
    needs = (F.col("full_text").isNotNull() & (F.col("full_text") != "")
             & (F.col("type_of_material") == "News"))
    if not overwrite:
        needs = needs & F.col("clean_text").isNull()
    return articles.withColumn(
        "clean_text", F.when(needs, clean_tokenize(F.when(needs, F.col("full_text")))).otherwise(F.col("clean_text")))


def clean_batch(articles: DataFrame, batch: DataFrame) -> DataFrame:
    """Clean the rows of the table whose article_id is in ``batch``."""
    ids = batch.select("article_id").distinct().withColumn("_in_batch", F.lit(True))
    out = articles.join(ids, "article_id", "left")
    return out.withColumn(
        "clean_text", F.when(F.col("_in_batch"), clean_tokenize("full_text"))
        .otherwise(F.col("clean_text"))).drop("_in_batch")

