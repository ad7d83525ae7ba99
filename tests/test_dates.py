import datetime as dt

from pyspark.sql import functions as F

from trendlens.functions import dates as D
from trendlens.operators.filters import filter_date_range


def test_string_month_bounds(spark):
    df = spark.createDataFrame([(1, "2001-10-31T23:00:00Z"), (2, "2001-11-01T00:00:00Z"),
                                (3, "2001-09-01T00:00:00Z")], "article_id long, pub_date string")
    closed = {r[0] for r in filter_date_range(df, "2001-10", "2001-11", "closed").collect()}
    assert closed == {1}
    opened = {r[0] for r in filter_date_range(df, "2001-09", "2001-11", "open").collect()}
    assert opened == {1, 3}


def test_next_month_and_shift(spark):
    df = spark.createDataFrame([("2013-12",), ("2014-09",), ("2001-09",)], "m string")
    r = df.select("m", D.next_month("m").alias("n"),
                  D.shift_back_weeks(D.month_start("m"), 3).alias("s")).collect()
    got = {x["m"]: (x["n"], x["s"]) for x in r}
    assert got["2013-12"][0] == "2014-01" and got["2014-09"][0] == "2014-10"
    assert got["2001-09"][1] == dt.date(2001, 8, 19)


def test_month_sequence_trailing_month(spark):
    t = spark.createDataFrame([(0,)], "topic int")
    months = [r["month"] for r in D.month_sequence(t, "2014-10", "2014-11", 1).collect()]
    assert months == ["2014-10", "2014-11", "2014-12"]


def test_date_helpers(spark):
    df = spark.createDataFrame([("2001-09-11T00:00:00Z",)], "p string")
    r = df.select(D.date_digits("p").alias("d")).first()["d"]
    assert r == "20010911"
    y, m, d = D.date_parts(F.lit("20010911"))
    assert df.select(y, m, d).first() == (2001, 9, 11)
    assert df.select(D.date_string(F.lit(2001), F.lit(9), F.lit(1))).first()[0] == "20010901"
