import csv
import json
import os
import tempfile

from pyspark.sql import functions as F

from trendlens.functions.numbers import order_key
from trendlens.operators import rollup as RU
from trendlens.operators import topic_stats as TS
from trendlens.operators.windows import rank_topics_per_doc
from trendlens.plans.trends import smooth_trend, smooth_trend_of
from trendlens.sources import sinks as SK
from trendlens.sources.fixtures import build_fixture
from trendlens.sources.tables import ARTICLE_SCHEMA

SF = "/root/testdata/sf0.001"
IDS = ARTICLE_SCHEMA["article_id"].dataType


def test_exports_are_single_files_that_read_back(spark):
    fx = build_fixture(spark, SF)
    out = tempfile.mkdtemp(prefix="trendlens-sink-", dir="/tmp")
    wide = SK.sink_trend_csv(smooth_trend(fx.doc_topics, fx.articles, fx.model.n_topics), fx.topics, f"{out}/new/trend.csv")
    rows = list(csv.reader(open(f"{out}/new/trend.csv")))
    assert rows[0] == ["date"] + [f"topic_{k}" for k in range(8)]
    assert len(rows) - 1 == wide.count() and [r[0] for r in rows[1:]] == sorted(r[0] for r in rows[1:])
    best = SK.sink_best_json(TS.best_overall(fx.doc_topics, fx.articles), fx.articles, fx.topics, f"{out}/best.json")
    whole = json.load(open(f"{out}/best.json"))
    assert list(whole) == [f"topic_{k}" for k in range(8)]
    assert all(set(a) <= {"pub_date", "lead_paragraph", "headline", "web_url"} for l in whole.values() for a in l)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(SK.read_best_json(spark, f"{out}/best.json")) == key(best)
    months = SK.sink_best_month_json(TS.best_per_month(fx.doc_topics, fx.articles), fx.articles, fx.doc_topics, fx.topics, f"{out}/m.json")
    assert key(SK.read_best_json(spark, f"{out}/m.json", SK.month_entry(IDS))) == key(months)
    cut = months.select(F.explode("articles").alias("a")).agg(F.percentile_approx("a.weight", .5)).first()[0]
    kept = SK.filter_best_json(f"{out}/m.json", cut, spark, IDS, f"{out}/kept.json")
    assert key(kept) == key(SK.filter_best_json(months, cut))
    kept = json.load(open(f"{out}/kept.json"))
    assert set(kept) == set(whole) and all(a["weight"] >= cut for l in kept.values() for a in l)
    SK.filter_best_json(months, 1e9, path=f"{out}/kept.json")         # an older file is replaced; empty topics stay
    assert json.load(open(f"{out}/kept.json")) == {name: [] for name in whole}
    days = SK.sink_daily_counts_json(TS.daily_counts(fx.articles, "20010831", "20010905"), f"{out}/days.json")
    assert json.load(open(f"{out}/days.json")) == {r["day"]: r["n"] for r in days.collect()}
    assert not os.path.isdir(f"{out}/days.json")


def test_object_keys_are_escaped_and_empty_objects_written(spark):
    out = tempfile.mkdtemp(prefix="trendlens-sink-", dir="/tmp")
    rows = spark.createDataFrame([('say "hi"', 1), ("é\\n,{", 2), (None, 3)], "name string, value long")
    SK.write_object(rows, "name", "value", f"{out}/o.json")
    assert json.load(open(f"{out}/o.json")) == {'say "hi"': 1, "é\\n,{": 2}
    assert SK.read_object(spark, f"{out}/o.json", "bigint").count() == 2
    SK.write_object(rows.limit(0), "name", "value", f"{out}/o.json")
    assert json.load(open(f"{out}/o.json")) == {} and SK.read_object(spark, f"{out}/o.json", "bigint").count() == 0


def test_ranks_do_not_depend_on_the_scale_of_weights(spark):
    fx = build_fixture(spark, SF)
    key = lambda df: sorted(map(str, df.drop("weight").collect()))
    for factor in (1e-3, 1e-9, 3e7):
        scaled = fx.doc_topics.withColumn("weights", F.transform("weights", lambda w: w * factor))
        assert key(rank_topics_per_doc(scaled)) == key(rank_topics_per_doc(fx.doc_topics))
        assert key(TS.best_overall(scaled, fx.articles)) == key(TS.best_overall(fx.doc_topics, fx.articles))
    nearly = spark.createDataFrame([(0.1 + 0.2, 0.3), (0.0, -0.0), (1e-300, 1e-300)], "a double, b double")
    assert all(r[0] for r in nearly.select(order_key("a") == order_key("b")).collect())
    assert spark.range(1).select(order_key(F.lit(None).cast("double"))).first()[0] is None


def test_rollup_of_increments_is_the_rollup_of_all(spark):
    fx = build_fixture(spark, SF)
    show = lambda r: sorted(str((*[x[c] for c in [*RU.KEYS, *RU.COUNTS]], round(x["weight_sum"], 9), x["best"])) for x in r.collect())
    whole = RU.topic_rollup(fx.doc_topics, fx.articles)
    parts = [RU.topic_rollup(fx.doc_topics.where(F.col("article_id") % 3 == k), fx.articles) for k in range(3)]
    assert show(RU.merge_rollups(*parts)) == show(whole)
    assert show(RU.merge_rollups(RU.merge_rollups(*parts[1:]), parts[0], whole.limit(0))) == show(whole)
    rows = lambda df: sorted(map(str, df.collect()))
    for ranked in (True, False):
        assert rows(smooth_trend_of(whole, 8, ranked, 4, True)) == rows(
            smooth_trend(fx.doc_topics, fx.articles, 8, ranked, month_interval=4, normalize=True))
    early = smooth_trend(fx.doc_topics, fx.articles, 8, start="2003-01").agg(F.min("date")).first()[0]
    assert str(early) > "2002-10"
