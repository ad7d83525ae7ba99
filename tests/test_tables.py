"""Bucketed article snapshots, stored models, and ids that are strings."""
import os

import pytest
from pyspark.sql import functions as F

from trendlens.operators import ingest as IN
from trendlens.operators import topic_stats as TS
from trendlens.operators.project import TopicModel, load_model, project_blocks, project_topics, store_topic_weights
from trendlens.operators.tfidf import tfidf_fit
from trendlens.plans.topics import article_relevance_w, final_topics, initial_topics, relevance_cut, relevant_docs
from trendlens.session import scratch_path
from trendlens.sources.buckets import BucketedArticles, bucket_of
from trendlens.sources.model_store import open_model, read_manifest, save_model, versions
from trendlens.sources.tables import ARTICLE_SCHEMA, article_schema

TEXTS = ["apples grow on trees in autumn", "trees and apples and pears", "rockets fly to the moon", "the moon and rockets and stars",
         "stars over apple trees", "pears rot", "", None]


def articles(spark, ids=lambda i: f"nyt://{i}", schema=article_schema()):
    rows = [(ids(i), f"u{i}", f"2002-{i % 9 + 1:02d}-03T00:00:00Z", "News", "article", (f"h{i}",), "lead", t, None, None)
            for i, t in enumerate(TEXTS * 3)]
    return IN.clean_missing(spark.createDataFrame(rows, schema))


def fitted(spark, a):
    docs = a.where("clean_text is not null").select("article_id", "clean_text")
    doc_terms, tfidf = tfidf_fit(docs, 50, (1, 2), 1.0)
    topic_terms = doc_terms.groupBy((F.length("term") % 3).cast("int").alias("topic"), "term").agg(F.sum("tfidf").alias("weight"))
    return doc_terms, load_model(tfidf, topic_terms, n_topics=3)


def files(table, buckets=None):
    return {f"{p}/{f}" for p in table.files(buckets) for f in os.listdir(p.removeprefix("file:")) if f.endswith(".parquet")}


def test_bucketed_updates_equal_whole_ones(spark):
    a = articles(spark).withColumn("full_text", F.when(F.col("article_id") != "nyt://0", F.col("full_text")).otherwise(""))
    table = BucketedArticles.create(a, scratch_path(spark, "articles"), 32)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(table.read()) == key(a)
    batch = a.where("article_id in ('nyt://1', 'nyt://2')").drop("full_text", "failed_scrape", "clean_text").withColumn(
        "web_url", F.concat(F.lit("new-"), "web_url")).withColumn("batch_pos", F.col("article_id"))
    after, ignored = table.upsert(batch)
    snap, also = IN.upsert_articles(a, batch)
    assert key(after.read()) == key(snap) and key(ignored) == key(also)
    touched = {r[0] for r in batch.select(bucket_of(32)).distinct().collect()}
    rest = set(range(32)) - touched
    assert files(after, rest) == files(table, rest) and not files(after, touched) & files(table, touched)
    assert key(table.read()) == key(a)                              # the version before is still there
    bodies = spark.createDataFrame([("u0", "a body"), ("u0", ""), ("u6", "")], "web_url string, body string")
    bodied = after.update_bodies(bodies)
    assert key(bodied.read()) == key(IN.update_bodies(after.read(), bodies))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):       # another update of that version was first
        after.clean_batch(batch.select("article_id"))
    cleaned = bodied.clean_batch(batch.select("article_id"))
    assert key(cleaned.read()) == key(IN.clean_batch(bodied.read(), batch.select("article_id")))
    assert after.upsert(batch)[0].version == after.version            # nothing new: no new version
    assert BucketedArticles.open(spark, table.path).version == cleaned.version
    assert key(BucketedArticles.open(spark, table.path, 1).read()) == key(a)
    none = BucketedArticles.create(a.limit(0), scratch_path(spark, "articles"), 4)
    assert none.read().count() == 0 and key(none.replace(a).read()) == key(a)


def test_a_page_of_several_versions_gives_one_row(spark):
    a = articles(spark).withColumn("full_text", F.lit(""))
    html = spark.createDataFrame([("u1", "<article><p>A</p></article>"), ("u1", ""), ("u1", None), ("other", "<p>")],
                                 "web_url string, html string")
    out = IN.update_bodies(a, html, ("article_p",))
    assert out.count() == a.count() and out.where("web_url = 'u1'").first()["full_text"] == "A"


def test_models_are_stored_whole(spark):
    a = articles(spark)
    _, model = fitted(spark, a)
    path = scratch_path(spark, "models")
    assert versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        open_model(spark, path)
    assert save_model(model, path, model_name="m") == 1
    rows = lambda m: sorted((r["article_id"], [round(x, 9) for x in r["weights"]]) for r in store_topic_weights(a, m).collect())
    own = rows(model)
    again = open_model(spark.newSession(), path)                     # another session's plans
    assert again.tfidf.ngram_range == (1, 2) and again.n_topics == 3 and rows(again) == own
    # an interrupted save: tables without a manifest
    model.tfidf.vocab.write.parquet(f"{path}/version=2/vocab")
    assert versions(spark, path) == [1] and read_manifest(spark, path)[0] == 1
    assert save_model(model, path, "sqrt") == 3 and read_manifest(spark, path)[1]["normalize"] == "sqrt"
    kept = spark.createDataFrame([(0, True), (1, False), (2, True)], "topic int, keep boolean")
    assert open_model(spark, path, kept).n_topics == 2
    with pytest.raises(FileNotFoundError):
        open_model(spark, path, version=2)


def test_wide_models_project_by_blocks(spark):
    doc_terms, model = fitted(spark, articles(spark))
    rows = lambda df: sorted((r["article_id"], [round(x, 9) for x in r["weights"]]) for r in df.collect())
    assert rows(project_blocks(doc_terms, model)) == rows(project_topics(doc_terms, model))
    model.tfidf.max_features = 50_000_000                          # beyond what may be broadcast
    assert "MapInArrow" in project_topics(doc_terms, TopicModel(model.tfidf, model.topic_terms, 3))._jdf.queryExecution().toString()


def test_pipelines_of_string_ids_and_of_nothing(spark):
    a = articles(spark)
    res, top, _ = initial_topics(a, max_features=40, ngram_range=(1, 1), max_df=1.0, n_topics=2, n_top_words=4, max_iter=5)
    assert top.count() == 6 and {r["article_id"] for r in res.W.collect()} == {f"nyt://{i}" for i in range(24) if i % 8 < 6}
    relevance = article_relevance_w(res.W, spark.createDataFrame([(0, 1.0)], "topic int, relevance double"))
    cut = relevance_cut(relevance, .5)
    docs = relevant_docs(a, relevance, quantile=.5)
    assert docs.count() == relevance.where(F.col("relevance") >= cut).count() < relevance.count()
    _, final, terms = final_topics(a, relevance, max_features=40, ngram_range=(1, 1), max_df=1.0, n_topics=2, n_top_words=4,
                                   max_iter=5, quantile=.5)
    objective = [r["objective"] for r in final.history.orderBy("iteration").collect()]
    x = docs.count()                                              # rows of X have length 1, so ||X||^2 is their number
    assert objective[-1] < x and all(b <= a_ + 1e-9 for a_, b in zip(objective, objective[1:]))
    # no article is relevant, or there is none
    for kwargs in ({"threshold": 1e9}, {"quantile": .5, "predicate": F.lit(False)}):
        tf, none, terms = final_topics(a, relevance, n_topics=2, **kwargs)
        assert terms.count() == 0 and none.W.count() == 0 and none.H.count() == 0 and tf.vocab.count() == 0
    with pytest.raises(ValueError):
        relevant_docs(a, relevance)


def test_rankings_of_string_ids(spark):
    a = articles(spark)
    _, model = fitted(spark, a)
    dt = store_topic_weights(a, model)
    best = TS.best_overall(dt, a, top_count=3)
    assert best.where("rank = 1").count() == 3
    months = TS.best_per_month(dt, a, "2002-01", "2002-12")
    assert months.where("article_id is not null").count() > 0
    assert ARTICLE_SCHEMA["article_id"].dataType.typeName() == "long"
