"""Parquet table sources and the article record schema."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HEADLINE = T.StructType([T.StructField("main", T.StringType())])

def article_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """One article record (fields of the search API plus the columns the pipeline adds);
    ids are strings there, and may be of any type."""
    return T.StructType([
        T.StructField("article_id", id_type),
        T.StructField("web_url", T.StringType()),
        T.StructField("pub_date", T.StringType()),
        T.StructField("type_of_material", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("headline", HEADLINE),
        T.StructField("lead_paragraph", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("failed_scrape", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ])


ARTICLE_SCHEMA = article_schema(T.LongType())     # of the test profile
DERIVED = ("full_text", "failed_scrape", "clean_text")


def landed_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """One landed search result: the query, its number of hits, the record's position
    among them, and the record."""
    return T.StructType([T.StructField("query", T.StringType()), T.StructField("hits", T.LongType()),
                         T.StructField("position", T.LongType()),
                         *(f for f in article_schema(id_type).fields if f.name not in DERIVED)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) raw web pages."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
