"""Stage tables are built when they are asked for, and their steps handle no more than asked."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trendlens.functions import words
from trendlens.functions.text import clean_tokenize, clean_tokens
from trendlens.operators import grams
from trendlens.operators.ingest import clean_missing
from trendlens.plans import catalog
from trendlens.sources import fixtures

SF = "/root/testdata/sf0.001/"           # a key of its own: no other test has built these
RNG = random.Random(8)


def test_a_query_pays_for_its_own_stages_only(spark):
    catalog.load_all()
    assert catalog.QUERIES["vocab_topk"](spark, SF).count() > 0
    fx = fixtures.build_fixture(spark, SF)
    assert set(fx.paths) == {"articles"}
    assert fx.doc_topics.count() == fx.raw_doc_topics.count() > 0
    before = dict(fx.paths)
    assert {"vocab", "doc_terms", "topic_terms", "raw_doc_topics", "doc_topics"} <= set(before)
    assert catalog.QUERIES["topic_count_best"](spark, SF).count() == fixtures.FIXTURE_TOPICS
    assert fixtures.build_fixture(spark, SF).paths == before        # written once
    assert fixtures.build_fixture(spark, SF, reuse=False).paths == {} and fx.paths == before


def test_only_texts_that_are_cleaned_go_to_the_cleaner(spark):
    rows = [(1, "News", "The Whole STORY", None), (2, "Letter", "Dear editor", None), (3, "News", "", None), (4, "News", "New", "old"),
            (5, None, "x y", None), (6, "News", None, None)]
    df = spark.createDataFrame(rows, "article_id long, type_of_material string, full_text string, clean_text string")
    out = clean_missing(df)
    assert {r[0]: r["clean_text"] for r in out.collect()} == {1: "whole story", 2: None, 3: None, 4: "old", 5: None, 6: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"run\(CASE WHEN", plan), plan


def test_words_of_texts_longer_than_a_part(spark, monkeypatch):
    parts = ["cannot", "Gonna", "wanna", "can't", " ", "\n", "é", "the", "zz9", "-", "q", "\x00"]
    texts = [None, ""] + [" ".join(RNG.choices(parts, k=RNG.randint(0, 40))) + RNG.choice(["", "cannot", "wanna"]) for _ in range(300)]
    seen = []
    slices = words.slices
    monkeypatch.setattr(words, "slices", lambda t, most=words.CHUNK_BYTES: seen.append(most) or slices(t, 64))
    got = words.vector_words(pa.array(texts)).to_pylist()
    assert got == [re.findall("[a-z0-9]{2,}", t or "") for t in texts] and seen == [words.PART_BYTES]
    assert words.vector_words(pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    assert df.where(~clean_tokenize("t").eqNullSafe(F.array_join(clean_tokens("t"), " "))).count() == 0


def test_vocabulary_finds_what_a_dictionary_finds(monkeypatch):
    searched = []
    plain = np.searchsorted
    kinds = [f"w{i}" for i in range(40)]
    for lo, hi in ((1, 1), (1, 3), (2, 3), (3, 3)):
        for size in (0, 1, 150):
            terms = sorted({" ".join(RNG.choices(kinds, k=RNG.randint(lo, hi))) for _ in range(size)})
            many = np.array([RNG.choice([0, 1, 2, 3, 30]) for _ in range(40)], np.int64)
            tokens = RNG.choices(kinds + ["out", "side"], k=int(many.sum()))
            want, at = Counter(), 0
            for m in many:
                for n in range(lo, hi + 1):
                    for i in range(at, at + m - n + 1):
                        if " ".join(tokens[i:i + n]) in terms:
                            want[i, " ".join(tokens[i:i + n])] += 1
                at += m
            monkeypatch.setattr(grams.np, "searchsorted", lambda a, v: searched.append(len(v)) or plain(a, v))
            found = list(grams.Vocabulary(terms, lo, hi).found(pa.array(tokens, pa.string()), many))
            monkeypatch.setattr(grams.np, "searchsorted", plain)
            assert Counter((int(a), terms[t]) for starts, own in found for a, t in zip(starts, own)) == want
            assert sum(searched) <= 1.2 * sum(want.values()) + 5   # what is not in it is not searched for
            searched.clear()
