from pyspark.sql import functions as F

from trendlens.functions.text import clean_tokenize, doc_word_count, ngrams, vector_tokens
from trendlens.operators.tfidf import tfidf_fit


def _clean(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(clean_tokenize("t")).collect()]


def test_clean_tokenize_pins(spark):
    got = _clean(spark, ["Al-Islam's café, cannot!", "", "!!! ... ???", "a\tb\nxx", "a b cc",
                         "Gonna wanna go", "Swiss Re said"])
    assert got == ["alislams caf", "", "", "b xx", "b cc", "gon na wan na", "swiss re"]


def test_one_char_tokens_dropped_before_ngrams(spark):
    df = spark.createDataFrame([("xx b yy",)], "t string")
    r = df.select(ngrams(vector_tokens("t"), (1, 2)).alias("g")).first()["g"]
    assert r == ["xx", "yy", "xx yy"]


def test_ngrams_short_docs(spark):
    df = spark.createDataFrame([("aa",), ("",)], "t string")
    got = [r["g"] for r in df.select(ngrams(vector_tokens("t"), (1, 3)).alias("g")).collect()]
    assert sorted(map(tuple, got)) == [(), ("aa",)]


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("aa b cc",)], "t string")
    assert sorted(r[0] for r in df.select(doc_word_count("t")).collect()) == [0, 3]


def test_max_df_fraction_vs_count_and_idf_plus_one(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa dd"), (4, "aa bb")],
                                 "article_id long, clean_text string")
    _, m1 = tfidf_fit(docs, None, (1, 1), 1.0)
    v1 = {r["term"]: r for r in m1.vocab.collect()}
    assert "aa" in v1 and abs(v1["aa"]["idf"] - 1.0) < 1e-12      # in every doc: idf = 1
    _, m08 = tfidf_fit(docs, None, (1, 1), 0.8)
    assert "aa" not in {r["term"] for r in m08.vocab.collect()}
    _, m2 = tfidf_fit(docs, None, (1, 1), 2)                          # int = document count
    assert {r["term"] for r in m2.vocab.collect()} == {"bb", "cc", "dd"}


def test_tfidf_rows_unit_norm_and_topk_ties(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb dd"), (3, "ee")],
                                 "article_id long, clean_text string")
    x, m = tfidf_fit(docs, 2, (1, 1), 1.0)
    # ctf: aa 2, bb 2, others 1 -> top 2 = aa, bb
    assert sorted(r["term"] for r in m.vocab.collect()) == ["aa", "bb"]
    norms = x.groupBy("article_id").agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    assert {r["article_id"] for r in norms} == {1, 2}                 # doc 3 has no vocab term
