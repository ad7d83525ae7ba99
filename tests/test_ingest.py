from pyspark.sql import functions as F

from trendlens.operators import ingest as IN
from trendlens.operators.html import TEST_PROFILE_RULES, extract_one
from trendlens.sources.tables import ARTICLE_SCHEMA, landed_schema

COLS = [f.name for f in ARTICLE_SCHEMA.fields]


def _art(spark, rows):
    full = [dict(zip(["article_id", "web_url", "pub_date"], r)) for r in rows]
    data = [tuple(d.get(c) for c in ["article_id", "web_url", "pub_date"]) + (
        "News", "article", ("h",), "lead", "body", None, None) for d in full]
    return spark.createDataFrame(data, ARTICLE_SCHEMA)


def test_upsert_semantics(spark):
    existing = _art(spark, [(1, "u1", "2001"), (2, "u2", "2001")])
    batch = spark.createDataFrame(
        [(10, "u9", "2002", "News", "article", ("h",), "l", 0),
         (11, "u9", "2002", "News", "article", ("h",), "l", 1),     # same URL: first wins
         (2, "u5", "2002", "News", "article", ("h",), "l", 2),      # same id, new URL: replace
         (12, "u1", "2002", "News", "article", ("h",), "l", 3)],    # known URL: ignored
        "article_id long, web_url string, pub_date string, type_of_material string, "
        "document_type string, headline struct<main:string>, lead_paragraph string, batch_pos int")
    snap, ignored = IN.upsert_articles(existing, batch)
    got = {r["article_id"]: (r["web_url"], r["full_text"]) for r in snap.collect()}
    assert got == {1: ("u1", "body"), 2: ("u5", ""), 10: ("u9", "")}
    assert {r[0] for r in ignored.collect()} == {11, 12}


def test_html_rules():
    assert extract_one('<p itemprop="articleBody">A</p><p itemprop="articleBody">B&amp;C</p>') == (
        "A B&C", "itemprop_body")
    assert extract_one("<nyt_text>X <b>Y</b></nyt_text><p class='story-body-text'>Z</p>") == (
        "X Y", "nyt_text")
    assert extract_one('<div id="mod-a-body-first-para">A</div>'
                       '<div id="mod-a-body-after-first-para">B</div>') == ("AB", "mod_a_body")
    assert extract_one('<div id="mod-a-body-first-para">A</div>') == ("A", "mod_a_body")
    assert extract_one('<p class="story-body-text x">A</p><p class="story-body-text">B</p>') == (
        "A B", "story_body_text")
    assert extract_one("<div>nothing</div>") == ("", None)
    # unclosed <p>: later paragraphs nest inside it, so their text repeats
    body, rule = extract_one("<article><p><b>H<br><p>A</p><p>B</p></article>", TEST_PROFILE_RULES)
    assert rule == "article_p" and body == "HAB A B"


def test_update_bodies(spark):
    a = spark.createDataFrame(
        [(1, "u1", "d", "News", "article", ("h",), "l", "", None, None),
         (2, "u2", "d", "News", "article", ("h",), "l", "", None, None),
         (3, "u3", "d", "Op-Ed", "article", ("h",), "l", "", None, None)], ARTICLE_SCHEMA)
    bodies = spark.createDataFrame([("u1", "text"), ("u2", "")], "web_url string, body string")
    got = {r["article_id"]: (r["full_text"], r["failed_scrape"])
           for r in IN.update_bodies(a, bodies).collect()}
    assert got == {1: ("text", None), 2: ("", True), 3: ("", None)}


def test_clean_missing_idempotent(spark):
    a = spark.createDataFrame(
        [(1, "u1", "d", "News", "article", ("h",), "l", "Hello World", None, None),
         (2, "u2", "d", "Letter", "article", ("h",), "l", "Bonjour", None, None)], ARTICLE_SCHEMA)
    once = IN.clean_missing(a)
    twice = IN.clean_missing(once)
    assert sorted(map(tuple, once.select("article_id", "clean_text").collect())) == \
        sorted(map(tuple, twice.select("article_id", "clean_text").collect())) == \
        [(1, "hello world"), (2, None)]


def test_land_articles_pages_limit(spark, tmp_path):
    records = [("q", 25, i, f"id{i}", f"u{i}", f"2002-01-{i + 1:02d}T00:00:00Z", "News", "article", ("h",), "l")
               for i in range(25)]
    spark.createDataFrame(records, landed_schema()).write.json(f"{tmp_path}/landed")
    landed = IN.read_landed(spark, f"{tmp_path}/landed")
    assert IN.land_articles(landed, max_pages=10).count() == 25
    assert IN.land_articles(landed, max_pages=2).count() == 20
    assert IN.land_articles(landed.withColumn("hits", F.lit(9).cast("long"))).count() == 10
    pos = {r["article_id"]: (r["page"], r["pos"]) for r in IN.land_articles(landed).collect()}
    assert pos["id0"] == (0, 0) and pos["id24"] == (2, 4)
    cur = IN.ingest_cursor(IN.land_articles(landed)).first()
    assert cur["last_date"] == "20020125"
