"""The toxicity model learns from every labelled row outside the held-out fold."""
import zlib

import numpy as np

from trendlens.llm import toxicity


def test_no_labelled_row_is_left_out(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got, sizes = toxicity.training_rows(rows, labels)
    want = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert got.count() == len(want) == sizes[0] + sizes[1]
    assert got.where("part = 'model'").groupBy("toxic").count().agg({"count": "min"}).first()[0] > 5900
    assert got.where("part = 'curve' and toxic = 0").count() > 1400


def test_curve_equals_a_fit_in_one_place(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(size=(400, 2)) + y[:, None] * [1.0, -0.5]
    known = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, x)], "y long, p double, q double").repartition(5)
    got = toxicity.fit_curve(known, 0.2)
    weight = np.where(y == 1, 0.2 / y.sum(), 0.8 / (1 - y).sum())
    a = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(3), a.T @ (weight * (p - y)) + 1e-4 * w)
    slopes = w[1:] / x.std(0)
    assert np.allclose(got, [w[0] - slopes @ x.mean(0), *slopes], atol=1e-6)
