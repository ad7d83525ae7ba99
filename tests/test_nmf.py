import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlens.operators import blocks
from trendlens.operators.nmf import EPS, SWEEPS, TopicFactors, hals, nmf_fit, nmf_step


def _x(spark, n=12, v=9, seed=0, name=lambda d: d, kind="long"):
    rng = np.random.default_rng(seed)
    rows = [(name(d), f"t{t}", float(rng.random())) for d in range(n) for t in range(v) if rng.random() < 0.6]
    x = spark.createDataFrame(rows, f"article_id {kind}, term string, tfidf double")
    terms = spark.createDataFrame([(f"t{t}", t) for t in range(v)], "term string, term_id int")
    docs = sorted({r[0] for r in rows})
    dense = np.zeros((len(docs), v))
    for d, t, value in rows:
        dense[docs.index(d), int(t[1:])] = value
    return docs, dense, x, terms


def _start(keys, k, seed=0):
    return np.array([[(int(hashlib.md5(f"{key}:{j}:{seed}".encode()).hexdigest()[:8], 16) % 100_000 + 1) / 100_000
                      for j in range(k)] for key in keys])


def _dense(docs, v, w, h):
    gw = {r["article_id"]: r["w"] for r in w.collect()}
    gh = {r["term"]: r["h"] for r in h.collect()}
    return np.array([gw[d] for d in docs]), np.array([gh[f"t{t}"] for t in range(v)])


def _hals(w, p, g):
    """One entry at a time, in plain loops."""
    w = w.copy()
    for _ in range(SWEEPS):
        for k in range(len(g)):
            for i in range(len(w)):
                if g[k][k] > 0:
                    w[i, k] = max(0.0, w[i, k] + (p[i, k] - sum(w[i, j] * g[j][k] for j in range(len(g)))) / g[k][k])
    return w


@pytest.mark.parametrize("solver", ["mu", "hals"])
def test_one_step_matches_numpy(spark, solver):
    docs, X, x, terms = _x(spark)
    k = 3
    W, H = _start(docs, k), _start([f"t{t}" for t in range(9)], k)
    step = _hals if solver == "hals" else lambda c, p, g: c * p / (c @ g + EPS)
    W1 = step(W, X @ H, H.T @ H)
    H1 = step(H, X.T @ W1, W1.T @ W1)
    w1, h1 = nmf_step(x, terms, k, 0, 9, solver)
    got = _dense(docs, 9, w1, h1)
    assert np.allclose(got[0], W1) and np.allclose(got[1], H1)


@pytest.mark.parametrize("init,solver", [("nndsvd", "hals"), ("hash", "hals"), ("hash", "mu")])
def test_fit_nonnegative_and_monotone(spark, init, solver):
    docs, X, x, terms = _x(spark)
    res = nmf_fit(x, terms, 3, max_iter=6, tol=0.0, seed=1000, max_features=9, init=init, solver=solver)
    objs = [r["objective"] for r in res.history.orderBy("iteration").collect()]
    assert all(b <= a + 1e-9 for a, b in zip(objs, objs[1:]))
    W, H = _dense(docs, 9, res.W, res.H)
    assert W.min() >= 0 and H.min() >= 0
    assert abs(((X - W @ H.T) ** 2).sum() - objs[-1]) < 1e-6 * max(1.0, objs[-1])


def test_string_ids_and_documents_without_terms(spark):
    docs, X, x, terms = _x(spark, name=lambda d: f"nyt://{d:02d}", kind="string")
    spine = spark.createDataFrame([(d,) for d in [*docs, "empty", "empty", None]], "article_id string")
    res = nmf_fit(x, terms, 3, max_iter=4, tol=0.0, max_features=9, docs=spine)
    rows = {r["article_id"]: r["w"] for r in res.W.collect()}
    assert set(rows) == {*docs, "empty"} and rows["empty"] == [0.0] * 3
    numbers = nmf_fit(_x(spark)[2], terms, 3, max_iter=4, tol=0.0, max_features=9)
    last = lambda r: r.history.orderBy(F.desc("iteration")).first()["objective"]
    assert last(res) == pytest.approx(last(numbers))


def test_svd_start_is_the_svd(spark):
    docs, X, x, terms = _x(spark, n=30, v=20, seed=3)
    m = TopicFactors(x, terms, 4, 7, 20)
    state, turn, values = m.svd()
    u, s, vt = np.linalg.svd(X)
    assert np.allclose(values, s[:4], rtol=1e-3)
    assert np.allclose(np.abs((m.basis @ turn).T @ vt[:4].T).max(1), 1, atol=1e-2)
    w, h = m.start()
    W = np.array([r["w"] for r in m.x.rows(w).orderBy("article_id").collect()])
    # NNDSVD written out for the exact vectors
    for k in range(4):
        a, b = u[:, k], vt[k]
        sides = [(np.maximum(g * a, 0), np.maximum(g * b, 0)) for g in (1, -1)]
        a, b = max(sides, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        scale = np.sqrt(s[k] * np.linalg.norm(a) * np.linalg.norm(b))
        assert np.allclose(W[:, k], scale * a / np.linalg.norm(a), atol=.05)
        assert np.allclose(h[:, k], scale * b / np.linalg.norm(b), atol=.05)
    m.close()


def test_svd_start_beats_the_hashed_start(spark):
    rng = np.random.default_rng(5)
    truth = rng.random((60, 4)) ** 4 @ rng.random((4, 40)) ** 4
    rows = [(d, f"t{t}", float(truth[d, t])) for d in range(60) for t in range(40) if truth[d, t] > .01]
    x = spark.createDataFrame(rows, "article_id long, term string, tfidf double")
    terms = spark.createDataFrame([(f"t{t}", t) for t in range(40)], "term string, term_id int")
    first = lambda init: nmf_fit(x, terms, 4, 1, 0.0, 0, 40, init=init).history.first()["objective"]
    assert first("nndsvd") < first("hash")


def test_term_blocks_and_merge_trees_change_nothing(spark, monkeypatch):
    docs, X, x, terms = _x(spark, n=300, v=30, seed=4)
    whole = nmf_fit(x, terms, 3, 3, 0.0, 0, 30)
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 8 * 3 * 4)             # chunks of 4 terms
    monkeypatch.setattr(blocks, "FAN_IN", 2)
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 16)
    monkeypatch.setattr(blocks.DocBlocks.__init__, "__defaults__", (8 * 3 * 8,))   # term blocks of 8 terms
    cut = nmf_fit(x, terms, 3, 3, 0.0, 0, 30)
    for a, b in zip(_dense(docs, 30, whole.W, whole.H), _dense(docs, 30, cut.W, cut.H)):
        assert np.allclose(a, b)


def test_empty_matrices_and_more_topics_than_rank(spark):
    docs, X, x, terms = _x(spark)
    spine = spark.createDataFrame([(1,), (2,)], "article_id long")
    none = nmf_fit(x.limit(0), terms, 2, docs=spine, max_features=9)
    assert none.history.count() == 0 and {tuple(r["w"]) for r in none.W.collect()} == {(0.0, 0.0)}
    assert none.H.count() == 9 and nmf_fit(x.limit(0), terms.limit(0), 2, max_features=9).W.count() == 0
    wide = nmf_fit(x, terms, 12, 5, 0.0, 0, 9)
    assert wide.history.orderBy(F.desc("iteration")).first()["objective"] < 1e-1 * (X ** 2).sum()


def test_hals_skips_columns_without_weight():
    w = np.ones((2, 2))
    assert (hals(w, np.ones((2, 2)), np.array([[0.0, 0], [0, 2.0]])) == [[1, .5], [1, .5]]).all()


def test_plan_of_a_wide_model(spark):
    """At K = 200 a pass keeps X where it is, sends no term block above the bound, and
    has no array of K x K numbers in a row."""
    docs, X, x, terms = _x(spark, n=40, v=30)
    m = TopicFactors(x, terms, 200, 0, 100_000, init="hash")
    m.x.n_terms = 100_000
    blocks_ = m.x.sent(np.zeros((100_000, 200)))
    assert len(blocks_) == 3 and all(b.value.nbytes <= 64 << 20 for _, b in blocks_)
    for _, b in blocks_:
        b.unpersist()
    state = m.packed.select("block", F.col("start").alias("dense"))
    plan = m.x.x.join(state, "block")._jdf.queryExecution().executedPlan().toString()
    side = plan[:plan.index("InMemoryTableScan")]
    assert "Exchange" not in side.split("SortMergeJoin" if "SortMergeJoin" in plan else "BroadcastHashJoin")[-1]
    m.close()
