from trendlens.operators import topic_stats as TS
from trendlens.operators.topic_terms import topic_top_terms, topic_concise_terms
from trendlens.operators.windows import argmax_topic, rank_topics_per_doc, rolling_month_mean
from trendlens.sources.sinks import filter_best_json


def test_argmax_ties_and_zero_vector(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.3],), ([0.0, 0.0, 0.0],)], "weights array<double>")
    assert [r[0] for r in df.select(argmax_topic("weights")).collect()] == [1, 0]


def test_rank_ties_take_higher_topic(spark):
    df = spark.createDataFrame([(1, [0.2, 0.2, 0.1, 0.2])], "article_id long, weights array<double>")
    r = rank_topics_per_doc(df, 3).orderBy("rank").collect()
    assert [x["topic"] for x in r] == [3, 1, 0]


def test_top_terms_n_minus_one_and_ties(spark):
    rows = [(0, f"t{i:02d}", float(i // 2)) for i in range(40)]
    tt = spark.createDataFrame(rows, "topic int, term string, weight double")
    for n in (20, 30):
        got = topic_top_terms(tt, n).orderBy("rank").collect()
        assert len(got) == n - 1
        assert abs(sum(r["pct"] for r in got) - 100.0) < 1e-9
    top = topic_top_terms(tt, 20).orderBy("rank").collect()
    assert [r["term"] for r in top[:2]] == ["t39", "t38"]        # tie: later term first
    assert topic_concise_terms(topic_top_terms(tt, 20), 10).count() == 10


def _articles(spark, rows):
    return spark.createDataFrame(rows, "article_id long, pub_date string, type_of_material string, "
                                       "clean_text string")


def test_best_per_month_strictly_positive(spark):
    a = _articles(spark, [(1, "2002-01-05T00:00:00Z", "News", "x"),
                          (2, "2002-01-06T00:00:00Z", "News", "x"),
                          (3, "2002-02-06T00:00:00Z", "News", "x")])
    dtp = spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.2, 0.1])],
                                "article_id long, weights array<double>")
    got = {(r["month"], r["topic"]): (r["article_id"], r["weight"])
           for r in TS.best_per_month(dtp, a, "2002-01", "2002-02").collect()}
    assert got[("2002-01", 0)] == (1, 0.5)                         # tie: lowest id
    assert got[("2002-01", 1)] == (None, 0.0)
    assert got[("2002-02", 1)] == (3, 0.1)


def test_empire_counts_trailing_zero_month_and_zero_doc(spark):
    a = _articles(spark, [(1, "2001-10-05T00:00:00Z", "News", "x"),
                          (2, "2001-10-06T00:00:00Z", "News", "x")])
    dtp = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.3])],
                                "article_id long, weights array<double>")
    got = {(r["month"], r["topic"]): r["n"] for r in TS.empire_counts(dtp, a, "2001-10", "2001-10").collect()}
    assert got == {("2001-10", 0): 1, ("2001-10", 1): 1, ("2001-11", 0): 0, ("2001-11", 1): 0}


def test_rolling_mean_nulls(spark):
    m = spark.createDataFrame([("2001-09", 0, 3.0), ("2001-10", 0, 6.0), ("2001-11", 0, None),
                               ("2001-12", 0, 9.0), ("2002-01", 0, 3.0), ("2002-02", 0, 6.0)],
                              "month string, topic int, value double")
    got = [r["value"] for r in rolling_month_mean(m, 3).orderBy("month").collect()]
    assert got[:5] == [None, None, None, None, None] and got[5] == 6.0


def test_daily_counts_bounds(spark):
    a = _articles(spark, [(1, "2013-01-01T00:00:00Z", "News", None),
                          (2, "2013-01-03T00:00:00Z", "News", None)])
    got = {r["day"]: r["n"] for r in TS.daily_counts(a, "20130101", "20130103").collect()}
    assert got == {"20130102": 0, "20130103": 1}


def test_filter_best_json_threshold(spark):
    from pyspark.sql import types as T
    art = T.StructType([T.StructField("_id", T.LongType()), T.StructField("weight", T.DoubleType())])
    df = spark.createDataFrame([("a", [(1, 0.0009), (2, 0.001)]), ("b", [(3, 0.0001)])],
                               T.StructType([T.StructField("name", T.StringType()),
                                             T.StructField("articles", T.ArrayType(art))]))
    got = {r["name"]: [x["_id"] for x in r["articles"]] for r in filter_best_json(df, .001).collect()}
    assert got == {"a": [2], "b": []}


def test_topic_freq_shares_sum_to_one(spark):
    a = _articles(spark, [(i, f"2002-01-0{i}T00:00:00Z", "News", "x") for i in range(1, 5)])
    dtp = spark.createDataFrame([(i, [float(i), 1.0, 0.1]) for i in range(1, 5)],
                                "article_id long, weights array<double>")
    r = TS.topic_freq(dtp, a, "2002-01", "2002-02", n_articles=1).collect()
    shares = {x["topic"]: x["share"] for x in r}
    assert abs(sum(shares.values()) - 1) < 1e-12
    tops = {x["topic"]: x["article_id"] for x in r}
    assert tops[0] == 4 and tops[2] is None
