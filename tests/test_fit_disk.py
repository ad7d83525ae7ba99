"""A fit keeps on disk what its next pass reads, however many passes it makes."""
import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlens.operators.blocks import Sparse, narrow, wide
from trendlens.operators.nmf import nmf_fit
from trendlens.operators.tfidf import buckets_for, candidate_stats, packed_weights, partition_docs, tfidf_fit
from trendlens.session import SHUFFLE_CLEANUP, ensure_checkpoint_dir

DOCS = [(1, "red fish blue fish"), (2, "blue sea"), (2, "red sea"), (3, ""), (4, "zz"), (None, "red blue"), (None, "sea sea sea"), (5, None),
        *((i, "one two three four five six"[: i % 24]) for i in range(6, 300))]


def _docs(spark):
    return spark.createDataFrame(DOCS, "article_id long, clean_text string").where("clean_text is not null").repartition(3)


def test_more_iterations_leave_no_more_files(spark):
    rng = np.random.default_rng(1)
    rows = [(d, f"t{t}", float(rng.random())) for d in range(40) for t in range(12) if rng.random() < .6]
    x = spark.createDataFrame(rows, "article_id long, term string, tfidf double")
    terms = spark.createDataFrame([(f"t{t}", t) for t in range(12)], "term string, term_id int")
    folder = urlparse(ensure_checkpoint_dir(spark)).path

    def left(n):
        before = set(os.listdir(folder))
        res = nmf_fit(x, terms, 3, max_iter=n, tol=0.0, max_features=12)
        assert res.history.count() == n and res.W.count() == 40 and res.H.count() == 12
        return sorted(name.split("-")[0] for name in set(os.listdir(folder)) - before)
    assert left(1) == left(6) == ["blocks", "chunks", "state"]
    assert spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")      # as it was


def test_packed_texts_are_the_weights(spark):
    docs = _docs(spark)
    x, model = tfidf_fit(docs, 12, (1, 2), 1.0)
    want = {(r.article_id, r.term): r.tfidf for r in x.collect()}
    name = {r.term_id: r.term for r in model.vocab.collect()}
    packed, idf = packed_weights(docs, model)
    got, ids = {}, []
    for r in packed.collect():
        block = Sparse(r.many, r.idx, r.val, idf)
        assert block.n == len(r.ids)
        ids += r.ids
        for row, term, value in zip(block.row, block.idx, block.val):
            got[r.ids[row], name[term]] = value
    assert sorted(ids) == sorted({d for d, t in DOCS if d is not None and t is not None})      # also those without a term
    assert got == pytest.approx({k: v for k, v in want.items() if k[0] is not None})
    assert packed.agg(F.sum("squares")).first()[0] == len({d for d, _ in want})      # the documents without an id count in X's norm


def test_fits_of_texts_and_of_their_weights_agree(spark):
    docs = _docs(spark)
    x, model = tfidf_fit(docs, 12, (1, 2), 1.0)
    last = [nmf_fit(x, model.vocab, 2, 5, 0.0, 0, 12, docs=docs, packed=p) for p in (None, packed_weights(docs, model))]
    values = [[(r["iteration"], round(r["objective"], 8)) for r in res.history.orderBy("iteration").collect()] for res in last]
    assert values[0] == values[1] and len(values[0]) == 5
    assert [res.W.count() for res in last] == [len({d for d, t in DOCS if d is not None and t is not None})] * 2


def test_unsent_vocabularies_are_not_packed(spark):
    docs = _docs(spark)
    assert packed_weights(docs, tfidf_fit(docs, None, (1, 1), 1.0)[1]) is None


def test_numbers_take_the_bytes_they_need():
    for most, size in ((0, 1), (255, 1), (256, 2), (70_000, 4), (1 << 40, 8)):
        held = narrow(np.array([0, most]))
        assert len(held) == 1 + 2 * size and wide(held).tolist() == [0, most]
    assert wide(narrow(np.zeros(0, np.int64))).tolist() == []


def test_more_buckets_for_a_larger_vocabulary_and_the_same_counts(spark):
    assert [buckets_for(n) for n in (5, 5000, 20_000, 50_000, 10 ** 9)] == [1 << 18, 1 << 19, 1 << 21, 1 << 22, 1 << 22]
    docs_p, n = partition_docs(_docs(spark)), F.lit(300.0)
    top = [sorted(map(tuple, candidate_stats(docs_p, n, 6, (1, 2), 1.0, b).orderBy(F.desc("ctf"), "term").limit(6).collect())) for b in (1, 7, 1 << 17)]
    assert top[0] == top[1] == top[2] and len(top[0]) == 6
