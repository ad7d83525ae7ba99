"""Stored topic models: a folder of versions, each with its tables and a manifest.

    <path>/version=<n>/vocab        (term, term_id, df, ctf, idf)
    <path>/version=<n>/topic_terms  (topic, term, weight)
    <path>/version=<n>/manifest     one JSON row: n-gram range, features, topics, ...

The manifest is written last, so a version without one (an interrupted save) does not
exist for readers, and a version is never written into again.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import TopicModel, load_model
from ..operators.tfidf import TfidfModel

FORMAT = 1
VOCAB = "term string, term_id int, df long, ctf long, idf double"
TOPIC_TERMS = "topic int, term string, weight double"


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the version folders under ``path``, finished or not."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())


def _finished(spark: SparkSession, folder: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    return [v for v in _folders(spark, path) if _finished(spark, f"{path}/version={v}")]


def save_model(model: TopicModel, path: str, normalize: str = "linear", model_name: str = "model") -> int:
    """Write ``model`` as the next version under ``path``; returns its number."""
    spark = model.topic_terms.sparkSession
    version = max(_folders(spark, path), default=0) + 1
    folder = f"{path}/version={version}"
    table = lambda df, schema: df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
    table(model.tfidf.vocab, VOCAB).write.parquet(f"{folder}/vocab")
    table(model.topic_terms, TOPIC_TERMS).write.parquet(f"{folder}/topic_terms")
    manifest = {"format": FORMAT, "model_name": model_name, "normalize": normalize, "n_topics": model.n_topics,
                "ngram_low": model.tfidf.ngram_range[0], "ngram_high": model.tfidf.ngram_range[1],
                "max_features": model.tfidf.max_features}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return version


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest) of the given or the newest finished version."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no finished model {'' if version is None else f'version {version} '}under {path}")
    version = found[-1] if version is None else version
    manifest = json.loads(spark.read.text(f"{path}/version={version}/manifest").first()["value"])
    if manifest["format"] != FORMAT:
        raise ValueError(f"model format {manifest['format']} is not known")
    return version, manifest


def open_model(spark: SparkSession, path: str, topics: DataFrame | None = None, version: int | None = None) -> TopicModel:
    """The stored model, with only the kept topics if ``topics`` is given (re-indexed
    0..K'-1, see ``load_model``)."""
    version, manifest = read_manifest(spark, path, version)
    folder = f"{path}/version={version}"
    tfidf = TfidfModel(spark.read.schema(VOCAB).parquet(f"{folder}/vocab"),
                       (manifest["ngram_low"], manifest["ngram_high"]), manifest["max_features"])
    return load_model(tfidf, spark.read.schema(TOPIC_TERMS).parquet(f"{folder}/topic_terms"), topics, manifest["n_topics"])
