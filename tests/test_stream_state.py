"""New URLs are found by Spark's own state operator, from the first record of each URL."""
import random

import pyarrow as pa

from trendlens.operators.project import TopicModel
from trendlens.operators.tfidf import TfidfModel
from trendlens.session import scratch_path
from trendlens.streaming import ingest
from trendlens.streaming.ingest import ORDER, first_of_urls, stream_ingest

RNG = random.Random(3)


def test_first_records_of_a_task(monkeypatch):
    rows = [{"web_url": f"u{RNG.randrange(30)}", "record": int(RNG.random() < .9), "query": RNG.choice([None, "a", "b"]), "page": RNG.choice([None, 0, 1]),
             "pos": RNG.randrange(3), "headline": {"main": None if i % 3 else "x"}, "article_id": None if i % 5 == 0 else (1 << 60) + i} for i in range(400)]
    key = lambda r: (r["record"], *((r[c] is None, r[c] or 0) if c != "query" else (r[c] is None, r[c] or "") for c in ORDER))
    want = {u: min((r for r in rows if r["web_url"] == u), key=key) for u in {r["web_url"] for r in rows}}
    schema = pa.schema([("web_url", pa.string()), ("record", pa.int32()), ("query", pa.string()), ("page", pa.int32()), ("pos", pa.int32()),
                        ("headline", pa.struct([("main", pa.string())])), ("article_id", pa.int64())])
    for least in (1, 40, 10 ** 6):                        # whenever they are compared
        monkeypatch.setattr(ingest, "LEAST_ROWS", least)
        got = [r for b in first_of_urls(pa.RecordBatch.from_pylist(rows[a:a + 7], schema) for a in range(0, 400, 7)) for r in b.to_pylist()]
        assert len(got) == len(want) and {r["web_url"]: r for r in got} == want
    assert list(first_of_urls(iter([]))) == [] and list(first_of_urls(iter([pa.RecordBatch.from_pylist([], schema)]))) == []


def test_known_urls_come_in_once_and_before_all_records(spark):
    terms = spark.createDataFrame([("sea", 0, 1.0)], "term string, term_id int, idf double")
    model = TopicModel(TfidfModel(terms, (1, 1), 1), spark.createDataFrame([(0, "sea", 1.0)], "topic int, term string, weight double"), 1)
    pages = spark.createDataFrame([(f"u{i}", "<article><p>sea sea</p></article>") for i in range(5)], "web_url string, html string")
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "out", "ckpt"))
    record = lambda url, pos, name: {"query": "q", "hits": 100, "position": pos, "article_id": name, "web_url": url, "type_of_material": "News"}
    from trendlens.sources.tables import landed_schema

    def land(*records):
        spark.createDataFrame(list(records), landed_schema()).coalesce(1).write.mode("append").json(landing)

    def run(known):
        q = stream_ingest(spark, landing, pages, model, out, ckpt, "m", ("article_p",), known=known)
        q.awaitTermination()
        return q, {r["article_id"]: r["full_text"] for r in spark.read.parquet(f"{out}/articles").collect()}
    known = spark.createDataFrame([("u0",), ("u0",), (None,), ("u1",)], "web_url string")
    land(record("u0", 3, "old"))                          # nothing new: no file is written
    q = stream_ingest(spark, landing, pages, model, out, ckpt, "m", ("article_p",), known=known)
    q.awaitTermination()
    assert [o.operatorName for o in q.lastProgress.stateOperators] == ["dedupe"]
    land(record("u2", 7, "late"), record("u2", 1, "first"), record("u1", 0, "old"), record(None, 0, "none"))
    assert run(None)[1] == {"first": "sea sea"}           # a later start has them from the first one
    land(record("u2", 0, "again"), record("u3", 0, "new"))
    assert run(spark.createDataFrame([("u3",)], "web_url string"))[1] == {"first": "sea sea", "new": "sea sea"}
