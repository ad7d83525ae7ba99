"""The vector-aggregate path used above K = 64 gives the same sums as the
per-topic columns."""
import numpy as np
from trendlens.operators import project as P
from trendlens.operators.tfidf import TfidfModel


def test_project_topics_paths_agree(spark):
    x = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "b", 1.0)],
                              "article_id long, term string, tfidf double")
    tt = spark.createDataFrame([(0, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0)],
                               "topic int, term string, weight double")
    model = P.TopicModel(TfidfModel(spark.createDataFrame([], "term string, idf double"),
                                    (1, 1), 10), tt, 3)
    narrow = {r["article_id"]: r["weights"] for r in P.project_topics(x, model).collect()}
    old = P.WIDE_K
    try:
        P.WIDE_K = 0
        wide = {r["article_id"]: r["weights"] for r in P.project_topics(x, model).collect()}
    finally:
        P.WIDE_K = old
    assert np.allclose(narrow[1], [1.2, 2.4, 0.6]) and np.allclose(narrow[2], [0.0, 3.0, 0.0])
    for k in narrow:
        assert np.allclose(narrow[k], wide[k])
