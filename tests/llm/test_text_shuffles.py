"""Joins with ids move only the texts that the ids are likely to be those of."""
from trendlens.llm import stages, toxicity


def test_texts_without_labels_are_not_shuffled(spark):
    docs = spark.range(5000).selectExpr("nullif(id, 7) as doc_id", "'t' as text")
    known = spark.range(0, 5000, 10).selectExpr("id as doc_id", "1 as toxic", "'model' as part")
    got = toxicity.likely(docs, known)
    ids = [r[0] for r in got.select("doc_id").collect()]
    assert set(range(0, 5000, 10)) <= set(ids) and len(ids) < 520
    assert got.columns == ["doc_id", "text"]
    assert toxicity.likely(docs.union(docs), known).count() == 2 * len(ids)


def test_rows_that_stay_are_not_shuffled(spark):
    docs = spark.range(4000).selectExpr("nullif(id % 900, 7) as doc_id", "concat('t', id) as text")
    rows = stages.numbered(docs.repartition(5))
    gone = rows.where("doc_id % 20 = 3 or doc_id is null").select(stages.F.col(stages.ROW).alias("doc_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = stages.without(rows, gone.union(gone))
        assert got.columns == ["doc_id", "text"]
        want = rows.where("not (doc_id % 20 = 3 or doc_id is null)").select("doc_id", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        moved = stages.moved_and_kept(rows, gone)
        assert moved[0].count() < 450 and moved[0].count() + moved[1].count() == 4000
        assert stages.without(rows, gone.limit(0)).count() == 4000 and stages.without(rows.limit(0), gone).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
