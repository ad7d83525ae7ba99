"""Active-entry Lloyd and threshold-algorithm negatives against plain searches."""
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from trendlens.llm import lloyd, negatives
from trendlens.llm.fixedpoint import LONG, floors

ODD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [1.0, None] + [0.0] * 6, 2), (903, [float("inf")] + [0.0] * 7, 2)]
SCHEMA = "vec_id long, embedding array<double>, label int, error string, codes int, v int, dim int, row int"


def frame(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def whole(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def plain_lloyd(rows, parts, entries, rounds, scale):
    """{(vec_id, vector): (code, error)} and the digests by length, by full searches."""
    good = [(i, tuple(v), label) for i, v, label in rows if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    out, shas = {}, {}
    for dim in {len(v) for _, v, _ in good}:
        own = sorted((g for g in good if len(g[1]) == dim), key=lambda g: (g[0] is None, g[0] or 0, g[1]))
        cuts = [dim * k // parts for k in range(parts + 1)]
        x = [[whole(g[1], scale)[a:b] for a, b in zip(cuts, cuts[1:])] for g in own]
        books = [[list(r[p]) for r in x[:entries]] for p in range(parts)]
        for k in range(rounds + 1):
            codes = [[min(range(len(books[p])), key=lambda e: (sum((s - t) ** 2 for s, t in zip(r[p], books[p][e])), e))
                      for p in range(parts)] for r in x]
            if k < rounds:
                for p in range(parts):
                    for e in range(len(books[p])):
                        member = [r[p] for r, c in zip(x, codes) if c[p] == e]
                        if member:
                            books[p][e] = [sum(c) // len(member) for c in zip(*member)]
        for g, r, c in zip(own, x, codes):
            error = sum((s - t) ** 2 for p in range(parts) for s, t in zip(r[p], books[p][c[p]]))
            out[g[0], g[1]] = ("".join(f"{e:02x}" for e in c), min(error, LONG))
        shas[dim] = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return out, shas


def vectors(n=150, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 1)          # coarse values: many equal distances
    x[n // 2:n // 2 + n // 6] = x[3]                    # a hot vector
    return [(int(i * 3 % 1000), r.tolist(), int(i % 4)) for i, r in enumerate(x)]


def test_lloyd_equals_full_search(spark):
    rows = vectors() + ODD + [(6, [0.5] * 8, None), (6, [0.25] * 8, None), (None, [0.125] * 8, 1),
                              (5, [1.0, 2.0, 3.0], 9), (7, [], 9), (8, [1e3, -2e3, 5.0], 9)]
    coded, books = lloyd.compress(frame(spark, rows), 4, 6, 5, 16)
    want, shas = plain_lloyd(rows, 4, 6, 5, 16)
    out = lloyd.digests(coded, books).collect()
    assert len(out) == len(rows) - len(ODD)
    count = {}
    for i, v, label in rows:
        if (i, tuple(v or ())) in want:
            code, error = want[i, tuple(v)]
            count.setdefault(label, []).append(error)
    got = sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out)
    assert got == sorted((i or -1, *want[i, tuple(v)], sum(count[label]), shas[len(v)])
                         for i, v, label in rows if (i, tuple(v or ())) in want)


def test_lloyd_of_enormous_components(spark):
    rows = [(i, [float(10 ** (i % 7 * 40)), -1e300 if i % 3 else 0.0, 1e5 * i, 2.0], 0) for i in range(12)]
    coded, books = lloyd.compress(frame(spark, rows), 2, 3, 4)
    want, shas = plain_lloyd(rows, 2, 3, 4, lloyd.SCALE)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in lloyd.digests(coded, books).collect()}
    assert got == {i: want[i, tuple(v)] for i, v, _ in rows} and books.digest(4) == shas[4]
    assert lloyd.digests(coded, books).first()["label_error"] == LONG


def test_lloyd_of_few_and_no_rows(spark):
    rows = vectors()[:3]
    coded, books = lloyd.compress(frame(spark, rows))
    want, _ = plain_lloyd(rows, 8, 16, 6, lloyd.SCALE)
    assert sorted(r["code"] for r in lloyd.digests(coded, books).collect()) == sorted(code for code, _ in want.values())
    none, books = lloyd.compress(frame(spark, rows).limit(0))
    assert lloyd.digests(none, books).count() == 0


def test_active_entries_save_work_and_keep_ties():
    rng = np.random.default_rng(2)
    for k in range(40):
        x = rng.integers(-3, 4, (200, 2))
        old = rng.integers(-3, 4, (7, 2))
        code, distance, full = lloyd.assign(x, old, np.ones(7, bool), np.zeros(200, int), np.full(200, -1))
        new = old.copy()
        new[rng.choice(7, k % 4, replace=False)] += rng.integers(-1, 2, (k % 4, 2))
        got = lloyd.assign(x, new, (new != old).any(1), code, distance)
        want = lloyd.assign(x, new, np.ones(7, bool), np.zeros(200, int), np.full(200, -1))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert full == want[2] == 1400 and got[2] <= 1400


def plain_negatives(rows, every, k_pos, k_neg, scale):
    good = [(n, i, whole(v, scale), label) for n, (i, v, label) in enumerate(rows) if label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    hold = lambda s: max(-LONG - 1, min(LONG, s))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, i, q, label in good:
        if i is None or i % every:
            continue
        scored = [(hold(sum(a * b for a, b in zip(q, r))), j, of) for m, j, r, of in good if m != n and len(r) == len(q)]
        for score, j, _ in sorted((s for s in scored if s[2] == label), key=key)[:k_pos]:
            fit = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=key)[:k_neg]
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(fit, 1)]
    return out


def test_negatives_equal_a_full_search(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(negatives, "FIRST_DEPTH", 2)
    rows = vectors(200, 6, 3) + [(i, v and v[:6], label) for i, v, label in ODD] + [
        (10, [0.5] * 6, None), (20, [0.5] * 6, 1), (20, [0.5] * 6, 1), (20, [0.5] * 6, 2), (None, [0.5] * 6, 1), (None, [0.4] * 6, 2),
        (30, [0.0] * 6, 3), (40, [1.0, 2.0], 1), (41, [1.0, 2.0], 1), (42, [1.0, 1.9], 2), (50, [], 1), (51, [], 1), (52, [], 2)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, 3, 4, 8)
    text = lambda r: tuple(map(str, r))
    want = sorted(map(text, plain_negatives(rows, 10, 3, 4, 8)))
    assert len(want) > 100 and sorted(map(text, got.collect())) == want


def test_negatives_of_enormous_components_and_no_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e200, -1e9, 3.0, 1e7]) for _ in range(3)], i % 2) for i in range(30)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, 5, 5, 5, 256))
    assert negatives.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_walks_end_before_the_lists_do():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3)) * 100 // 1
    lists, seen = negatives.Lists(x), []
    walk = lists.walk

    def counted(*a):
        rows, scores = walk(*a)
        seen.append(len(rows))
        return rows, scores
    lists.walk = counted
    a = np.array([50.0, -70.0, 20.0])
    places, scores = negatives.positives_of(a, -1, lists, lambda s: s, 5)
    full = x @ a
    assert places.tolist() == np.argsort(-full, kind="stable")[:5].tolist() and seen[0] < 2000
    assert floors(np.array([[-0.1, 1e300]]), 10, 1 << 20).tolist() == [[-1, int(1e300) * 10]]
