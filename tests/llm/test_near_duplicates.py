"""Near duplicates in crowded buckets and small blocks, against all-pairs Jaccard."""
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from trendlens.llm import dartminhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(400))
    bases = [[word() for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(90):
        # a third of each text is that of its base, so that most texts of a family share buckets
        w = bases[i % 3][:40] + [word() for _ in range(20)] if i % 5 else list(bases[i % 3])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w * (1 + i % 2))))
    for i in range(90, 110):                                   # chains of small steps from a row before
        w = rows[i - 9][1].split()
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "w1 w2"), (203, "w1 w2"), (203, rows[4][1]), (4, rows[4][1])]


def shingles(text, weights):
    w = WORDS.findall((text or "").lower())
    n = min(5, len(w)) or 1
    c = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return c if weights == "count" else Counter(dict.fromkeys(c, 1))


def classes(rows, weights, least):
    texts = sorted({t or "" for _, t in rows})
    low = {t: min(i for i, u in rows if (u or "") == t) for t in texts}
    sets = {t: shingles(t, weights) for t in texts}
    edges = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1:]
             if sum((sets[a] & sets[b]).values()) >= least * sum((sets[a] | sets[b]).values()) > 0]
    for _ in texts:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((i, low[t or ""]) for i, t in rows)


@pytest.mark.parametrize("weights, sent", [("set", 4_000_000), ("count", 0)])
def test_classes_in_crowded_buckets(spark, monkeypatch, weights, sent):
    rows = corpus()
    monkeypatch.setattr(dartminhash, "BLOCK", 7)
    monkeypatch.setattr(dartminhash, "BROADCAST_IDS", sent)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = dartminhash.near_duplicates(df, weights=weights, bands=128)
    assert sorted((r["doc_id"], r["class_id"]) for r in got.collect()) == classes(rows, weights, 0.8)


def test_workers_forget_the_words_of_ended_tasks(spark):
    from trendlens.llm import dartminhash
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(64)], "doc_id long, text string").repartition(4)

    def kept(batches):
        from trendlens.llm.dartminhash import _HASH
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_HASH)] * batch.num_rows)], names=["n"])
    for made in (dartminhash.sign(docs, "set"), dartminhash.weighted_sets(docs.withColumnRenamed("doc_id", "id"), "count")):
        assert made.count() == 64
        assert made.collect()                                      # the workers are reused by the next tasks
        assert docs.mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 0
