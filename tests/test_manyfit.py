"""Many logistic fits against a dense Newton solution, leave-out sums against direct ones."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strophe.operators import manyfit as mf

CUES = ["a", "b"]
SYMBOLS = 4


def sample(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ctx, g, s = (-1 if i % 5 else r.randrange(2)), min(r.randrange(7), 4), r.randrange(SYMBOLS - 1)
        a, b = r.gauss(1, 2), r.gauss(-3, 0.5)
        rows.append((ctx, g, s, int(r.random() < 1 / (1 + np.exp(-(0.5 * a + (s - 1) * b + s)))), a, b))
    return rows


def dense(rows, fit):
    """Scaled, one-hot and crossed columns, plain Newton on the full design."""
    seen = [r for r in rows if r[0] in (-1, fit.ctx) and r[1] not in fit.out]
    x = np.array([r[4:] for r in seen])
    mean, dev = x.mean(axis=0), x.std(axis=0)

    def design(x, s):
        x, hot = (x - mean) / dev, np.eye(SYMBOLS)[s]
        cross = (x[:, :, None] * hot[:, None, :]).reshape(len(x), -1) if fit.interactions else np.zeros((len(x), 0))
        return np.column_stack((np.ones(len(x)), x, hot, cross))

    groups = [r[1] for r in seen]
    w = np.array([len(seen) / len(set(groups)) / groups.count(g) for g in groups])
    d, y = design(x, [r[2] for r in seen]), np.array([r[3] for r in seen], dtype=float)
    theta, ridge = np.zeros(d.shape[1]), np.ones(d.shape[1])
    ridge[0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ theta))
        h = fit.c * (d * (w * p * (1 - p))[:, None]).T @ d + np.diag(ridge)
        theta -= np.linalg.solve(h, fit.c * d.T @ (w * (p - y)) + ridge * theta)
    return lambda x, s: design(np.array(x), s) @ theta


@pytest.fixture(scope="module")
def rows(spark):
    data = sample()
    return data, spark.createDataFrame(data, "ctx int, g int, s int, y int, a double, b double").repartition(3).persist()


def test_fits_equal_dense_newton(spark, rows):
    data, df = rows
    fits = [mf.Fit("one", 0, frozenset(), 1.0), mf.Fit("two", 1, frozenset([4]), 0.01), mf.Fit("three", 0, frozenset([0, 2]), 10.0), mf.Fit("plain", 1, frozenset([1]), 0.1, False)]
    models = mf.fit_logistic(df, CUES, fits, mf.group_sums(df, CUES, 5), SYMBOLS)
    table = mf.linear_table(spark, models)
    got = {(r["model"], r["s"]): [r["b0"], r["b1"], r["b2"]] for r in table.collect()}
    assert len(got) == len(fits) * SYMBOLS
    points = [(0.3, -2.0), (-4.0, 1.0), (1.0, 1.0)]
    for f in fits:
        score = dense(data, f)
        for s in range(SYMBOLS):
            b = got[f.name, s]
            want = score(points, [s] * len(points))
            assert np.abs(np.array([b[0] + b[1] * a + b[2] * c for a, c in points]) - want).max() < 1e-7


def test_left_out_rows_do_not_matter(spark, rows):
    data, df = rows
    fit = [mf.Fit("f", 0, frozenset([4]), 1.0)]
    changed = spark.createDataFrame([(c, g, s, 1 - y if g == 4 else y, a * 9 if g == 4 else a, b) for c, g, s, y, a, b in data], df.schema)
    one, two = (mf.fit_logistic(d, CUES, fit, mf.group_sums(d, CUES, 5), SYMBOLS)[0].table for d in (df, changed))
    assert np.abs(one - two).max() < 1e-9


def test_constant_cues_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(-1, g, 0, 1, 2.0, float(g)) for g in range(3)] * 3, "ctx int, g int, s int, y int, a double, b double")
    sums = mf.group_sums(df, CUES, 3)
    models = mf.fit_logistic(df, CUES, [mf.Fit("x", 0, frozenset(), 1.0), mf.Fit("none", 0, frozenset([0, 1, 2]), 1.0)], sums, 2, max_passes=8)
    assert np.isfinite(models[0].table).all() and models[0].table[0, 0] > 1
    assert (models[1].table == 0).all()
    empty = df.limit(0)
    assert (mf.fit_logistic(empty, CUES, [mf.Fit("x", 0, frozenset())], mf.group_sums(empty, CUES, 3), 2)[0].table == 0).all()
