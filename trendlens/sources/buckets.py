"""The article table in buckets of the id's hash, updated by rewriting touched buckets.

    <path>/data/<write>/bucket=<b>/part-*    rows of bucket b as one update wrote them
    <path>/manifest/version=<n>              (bucket, write): where each bucket is

An update writes the buckets that its rows fall into to a fresh folder, then the manifest
of the next version, last: readers see the whole update or nothing of it, files of the
other buckets are untouched, and nothing is overwritten while it is read. Of two updates
of one version, the second to write its manifest fails.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_needs_body
from ..operators.html import DEFAULT_RULES
from ..operators.ingest import ARTICLE_COLUMNS, _body_changes, new_articles, with_bodies
from ..functions.text import clean_tokenize


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("article_id"), F.lit(n)).cast("int").alias("bucket")


@dataclass
class BucketedArticles:
    """One version of the table."""
    spark: SparkSession
    path: str
    version: int
    placed: dict[int, str]                    # bucket -> folder that holds it
    buckets: int

    @classmethod
    def create(cls, articles: DataFrame, path: str, buckets: int = 256) -> "BucketedArticles":
        empty = cls(articles.sparkSession, path, 0, {}, buckets)
        return empty._written(articles, set(range(buckets)))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> "BucketedArticles":
        """The given or the newest version whose manifest is complete."""
        if version is None:
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
            fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            found = [s.getPath() for s in fs.listStatus(root)]
            done = [int(p.getName()[8:]) for p in found if p.getName().startswith("version=")
                    and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
            if not done:
                raise FileNotFoundError(f"no table under {path}")
            version = max(done)
        rows = spark.read.schema("bucket int, folder string, buckets int").json(f"{path}/manifest/version={version}").collect()
        return cls(spark, path, version, {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}, rows[0]["buckets"])

    def files(self, buckets=None) -> list[str]:
        return [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(self.placed.items()) if buckets is None or b in buckets]

    def read(self, buckets=None) -> DataFrame:
        """Rows of all or of the given buckets."""
        paths = self.files(buckets)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    @property
    def schema(self):
        return self.spark.read.parquet(f"{self.path}/schema").schema

    def _written(self, rows: DataFrame, touched: set[int]) -> "BucketedArticles":
        """The next version: ``rows`` are all rows of the touched buckets."""
        version = self.version + 1
        rows = rows.select(*ARTICLE_COLUMNS)
        if not self.version:
            rows.limit(0).write.parquet(f"{self.path}/schema")
        name = f"{version}-{uuid.uuid4().hex[:12]}"
        folder = f"{self.path}/data/{name}"
        (rows.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket")
         .write.partitionBy("bucket").parquet(folder))
        # a bucket that has rows has a folder
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = {int(s.getPath().getName()[7:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("bucket=")}
        placed = {b: v for b, v in self.placed.items() if b not in touched} | {b: name for b in there}
        manifest = [(b, placed.get(b), self.buckets) for b in range(self.buckets)]
        self.spark.createDataFrame(manifest, "bucket int, folder string, buckets int").coalesce(1).write.json(
            f"{self.path}/manifest/version={version}")
        return BucketedArticles(self.spark, self.path, version, placed, self.buckets)

    def replace(self, rows: DataFrame) -> "BucketedArticles":
        """The version with ``rows`` inserted, or put in place of those with their ids
        (one row an id)."""
        rows = rows.select(*ARTICLE_COLUMNS).checkpoint(eager=True)
        touched = {r["bucket"] for r in rows.select(bucket_of(self.buckets)).distinct().collect()}   # at most ``buckets``
        if not touched:
            return self
        kept = self.read(touched).join(rows.select("article_id"), "article_id", "left_anti")
        return self._written(kept.select(*ARTICLE_COLUMNS).unionByName(rows), touched)

    def upsert(self, batch: DataFrame, order_col: str = "batch_pos") -> tuple["BucketedArticles", DataFrame]:
        """(the version with the batch's new records, ignored ids); see ``new_articles``.
        Of the table, only URLs and the touched buckets are read."""
        rows, ignored = new_articles(self.read().select("web_url"), batch, order_col)
        return self.replace(rows), ignored

    def update_bodies(self, source: DataFrame, rules=DEFAULT_RULES) -> "BucketedArticles":
        """The version with bodies attached where they are missing."""
        articles = self.read()
        return self.replace(with_bodies(articles, _body_changes(filter_needs_body(articles), source, rules), "inner"))

    def clean_batch(self, batch: DataFrame) -> "BucketedArticles":
        """The version with the rows of the batch's ids cleaned."""
        rows = self.read().join(batch.select("article_id").distinct(), "article_id", "left_semi")
        return self.replace(rows.withColumn("clean_text", clean_tokenize("full_text")))
