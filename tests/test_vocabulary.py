"""The vocabulary from candidates against plain counts, and term ids by ranges."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendlens.operators.tfidf import candidate_stats, numbered_terms, partition_docs, tfidf_fit
from trendlens.session import ensure_checkpoint_dir

RNG = random.Random(3)
WORDS = [f"w{chr(97 + i % 26)}{i}x" for i in range(150)]
DOCS = [(i, " ".join(RNG.choices(WORDS, [1 / (k + 1) for k in range(150)], k=RNG.randint(0, 60)))) for i in range(80)]
DOCS += [(900, ""), (901, None)]


def grams(text):
    w = (text or "").split()
    return [" ".join(w[i:i + n]) for n in (1, 2) for i in range(len(w) - n + 1)]


def by_hand(max_features, max_df):
    ctf, df = Counter(), Counter()
    for _, text in DOCS:
        ctf.update(grams(text))
        df.update(set(grams(text)))
    most = max_df if isinstance(max_df, int) else max_df * len(DOCS)
    kept = sorted((t for t in ctf if df[t] <= most), key=lambda t: (-ctf[t], t))[:max_features]
    return {t: (i, df[t], ctf[t]) for i, t in enumerate(sorted(kept))}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "article_id long, clean_text string")


@pytest.mark.parametrize("max_features, max_df, buckets", [
    (20, 0.8, 1 << 24), (20, 0.8, 64), (20, 3, 64), (1, 0.8, 1), (40, 0.2, 500), (10 ** 6, 1.0, 300), (None, 0.8, 64)])
def test_vocabulary_equals_plain_counts(spark, docs, max_features, max_df, buckets):
    _, model = tfidf_fit(docs, max_features, (1, 2), max_df, buckets=buckets)
    got = {r["term"]: (r["term_id"], r["df"], r["ctf"]) for r in model.vocab.collect()}
    assert got == by_hand(max_features, max_df)


def test_candidates_are_few_and_empty_texts_have_none(spark, docs):
    ensure_checkpoint_dir(spark)
    total = len(by_hand(None, 1.0))
    few = candidate_stats(partition_docs(docs), F.lit(float(len(DOCS))), 20, (1, 2), 1.0)
    assert 20 <= few.count() < total / 4
    _, model = tfidf_fit(docs.limit(0), 5, (1, 2))
    assert model.vocab.count() == 0


def test_term_ids_by_ranges(spark, docs):
    ensure_checkpoint_dir(spark)
    terms = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("term"), F.lit(1).alias("df"))
    got = [r["term"] for r in numbered_terms(terms).orderBy("term_id").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert [r["term_id"] for r in numbered_terms(terms).orderBy("term_id").collect()] == list(range(5000))
