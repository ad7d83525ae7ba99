"""N-grams in Arrow batches against plain counts: repeated and null ids, batches that cut
a document, n-grams that meet no row's end."""
import random
from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendlens.functions.text import ngrams
from trendlens.operators import grams, tfidf

RNG = random.Random(11)
ROWS = [(None if i % 10 == 0 else i % 17, " ".join(RNG.choices("ab cd ef gh ij kl".split(), k=RNG.randint(0, 12)))) for i in range(60)]
ROWS += [(3, None), (99, ""), (98, "zz\x01yy ab")]


def windows(text, hi=3):
    w = (text or "").replace("\x01", " ").split()
    return [" ".join(w[i:i + n]) for n in range(1, hi + 1) for i in range(len(w) - n + 1)]


def plain():
    tf = {}
    for d, text in ROWS:
        tf.setdefault(d, Counter()).update(windows(text))
    return tf


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_documents_stay_whole_over_batches(size):
    ids = [1, 1, 2, 3, 3, 3, None, None, 5]
    rows = pa.table({"id": pa.array(ids), "t": pa.array([[str(i)] * 3 for i in range(9)], pa.list_(pa.string()))})
    got = []
    for own, document, tokens, many in grams.whole_documents(iter(rows.to_batches(max_chunksize=size)), most=4):
        got += own.to_pylist()
        assert len(own) == document.max() + 1 and len(tokens) == many.sum()
    assert got == [1, 2, 3, None, 5]


def test_numbers_of_many_words_do_not_overflow():
    code = np.array([0, 1, 0, 1, 2, 0, 1], np.int64)
    found = {n: number for n, _, number in grams.numbered(code, 1 << 40, np.array([7]), 1, 3)}
    assert [len(set(found[n].tolist())) for n in (1, 2, 3)] == [3, 4, 5]


def test_weights_and_vocabulary_equal_plain_counts(spark):
    docs = spark.createDataFrame(ROWS, "article_id long, clean_text string").repartition(3)
    x, model = tfidf.tfidf_fit(docs, 25, (1, 3), 1.0)
    tf = plain()
    ctf, df = Counter(), Counter()
    for own in tf.values():
        ctf.update(own)
        df.update(set(own))
    terms = sorted(ctf, key=lambda t: (-ctf[t], t))[:25]
    assert {r["term"]: (r["df"], r["ctf"]) for r in model.vocab.collect()} == {t: (df[t], ctf[t]) for t in terms}
    want = {}
    for d, own in tf.items():
        w = {t: own[t] * (log((1 + len(ROWS)) / (1 + df[t])) + 1) for t in terms if own[t]}
        want |= {(d, t): v / sqrt(sum(y * y for y in w.values())) for t, v in w.items()}
    got = {(r["article_id"], r["term"]): r["tfidf"] for r in x.collect()}
    assert got == pytest.approx(want)
    slow = tfidf.l2_normalise(tfidf.vocab_term_weights(tfidf.partition_docs(docs), model))
    assert {(r["article_id"], r["term"]): r["tfidf"] for r in slow.collect()} == pytest.approx(want)


def test_no_slice_of_the_tokens_per_position(spark):
    """A slice copies the array for every position: the work grew with a text's square."""
    df = spark.createDataFrame([(["a", "b", None, "c"],)], "t array<string>").select(ngrams("t", (1, 3)).alias("g"))
    assert df.first()["g"] == ["a", "b", None, "c", "a b", "b", "c", "a b", "b c"]
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()
