"""Words cut in Arrow batches against the expressions and plain Python."""
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from trendlens.functions import words
from trendlens.functions.text import clean_tokenize, clean_tokens
from trendlens.operators import tfidf

RNG = random.Random(5)
PARTS = ["cannot", "Cannot", "can't", "can", "not", "gimme", "gonna", "GOTTA", "lemme", "wanna", "wanna.", "wan", "na", " ", "  ", "\n", "\t",
         "\x0b", "\x1c", "\x01", "\x00", "\x7f", "é", "日本", "'", "_", "-", "the", "THE", "editor", "zz", "q", "9", "İ", "K", "\x85", "\xa0", "."]
TEXTS = [None, "", " "] + ["".join(RNG.choices(PARTS, k=RNG.randint(0, 25))) for _ in range(1500)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaning_equals_the_expressions_and_uses_none_of_them(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    assert df.where(~clean_tokenize("t").eqNullSafe(F.array_join(clean_tokens("t"), " "))).count() == 0
    text = plan(df.select(clean_tokenize("t")))
    assert "lambdafunction" not in text and "regexp" not in text


def test_vector_words_over_slices():
    got = []
    for batch in words.tokenised(iter([pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["id", "t"]).slice(1)])):
        got += batch.column(1).to_pylist()
    assert got == [re.findall("[a-z0-9]{2,}", t) for t in TEXTS[1:]]
    assert list(words.slices(pa.array(["ab", None, "cdef", "", "g"]), 3)) == [(0, 3), (3, 5)]
    assert list(words.slices(pa.array([], pa.string()))) == []


def test_all_ngrams_are_counted_before_they_become_rows(spark):
    rows = [(i % 13 or None, " ".join(RNG.choices("ab cd ef g".split(), k=RNG.randint(0, 9)))) for i in range(80)] + [(5, None)]
    docs = tfidf.partition_docs(spark.createDataFrame(rows, "article_id long, clean_text string"))
    got = tfidf.corpus_stats(docs, (1, 3))
    df, ctf, own = Counter(), Counter(), {}
    for d, text in rows:
        w = re.findall("[a-z0-9]{2,}", text or "")
        own.setdefault(d, []).extend(" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for terms in own.values():
        ctf.update(terms)
        df.update(set(terms))
    assert {r["term"]: (r["df"], r["ctf"]) for r in got.collect()} == {t: (df[t], ctf[t]) for t in ctf}
    assert "Generate" not in plan(got)
