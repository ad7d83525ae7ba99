"""Corpus pipeline: the stages that turn ``documents`` into encoded training text.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendlens.llm import stages
from trendlens.llm.common import prepare, stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_duplicates),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("secret_scan", stages.mask_secrets),
    ("sentencepiece", stages.encode_pieces),
]

# learned scores and token ids have no SQL form; tests/llm/test_stages.py holds the
# stages and run() against plain Python, the toxicity stage against planted rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the ``documents`` of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
