"""Best-first histogram trees against a plain greedy construction."""

from __future__ import annotations

import random

import numpy as np

from strophe.operators import boosting as bo
from strophe.operators import manyfit as mf

CUES = ["a", "b"]


def sample(n=500, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g, s, a, b = min(r.randrange(6), 3), r.randrange(3), round(r.gauss(0, 1), 2), r.choice([0.0, 1.0, 2.0])
        out.append((-1 if i % 7 else 0, g, s, int(r.random() < 1 / (1 + np.exp(-(2 * (a > 0.3) - 1.5 * (b > 1) + (s == 2))))), a, b))
    return out


def plain(rows, f):
    """Trees by trying every cut of every leaf on raw values."""
    seen = [r for r in rows if r[0] in (-1, f.ctx) and r[1] not in f.out]
    groups = [r[1] for r in seen]
    w = np.array([len(seen) / len(set(groups)) / groups.count(g) for g in groups])
    y = np.array([r[3] for r in seen], dtype=float)
    cols = [np.floor(np.array([r[4] for r in seen]) * 128), np.floor(np.array([r[5] for r in seen]) * 128)] + [(np.array([r[2] for r in seen]) == s) * 1.0 for s in range(3)]
    rate = (w * y).sum() / w.sum()
    score = np.full(len(y), np.log(rate / (1 - rate)))

    def best(m, g, h):
        value = lambda k: g[k].sum() ** 2 / (h[k].sum() + f.l2)
        top = (0.0, None)
        for c in cols:
            for cut in np.unique(c[m])[:-1]:
                left, right = m & (c <= cut), m & (c > cut)
                if left.sum() >= f.min_rows and right.sum() >= f.min_rows:
                    gain = value(left) + value(right) - value(m)
                    if gain > top[0] + 1e-9:
                        top = (gain, (left, right))
        return top

    for _ in range(f.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [np.ones(len(y), bool)]
        found = [best(leaves[0], g, h)]
        while len(leaves) < f.leaves and max(x[0] for x in found) > 0:
            i = max(range(len(leaves)), key=lambda k: found[k][0])
            parts = found[i][1]
            leaves[i:i + 1], found[i:i + 1] = parts, [best(q, g, h) for q in parts]
        for m in leaves:
            score[m] -= f.rate * g[m].sum() / (h[m].sum() + f.l2)
    return score, seen


def test_trees_equal_plain_ones(spark):
    data = sample()
    df = spark.createDataFrame(data, "ctx int, g int, s int, y int, a double, b double").repartition(3).persist()
    fits = [bo.Boost("x", 0, frozenset(), leaves=8, rounds=4, min_rows=20), bo.Boost("y", 5, frozenset([3]), leaves=3, rounds=6, rate=0.3)]
    models = bo.boosted_fit(df, CUES, fits, mf.group_sums(df, CUES, 4), 3, refresh=3)
    assert [len(m.trees) for m in models] == [4, 6] and all(1 < len(t.values) <= f.leaves for m, f in zip(models, fits) for t in m.trees)
    for m, f in zip(models, fits):
        want, seen = plain(data, f)
        rows = spark.createDataFrame([(i, *r) for i, r in enumerate(seen)], "key long, ctx int, g int, s int, y int, a double, b double")
        got = {r["key"]: r["score"] for r in bo.boosted_scores(rows, CUES, [m]).collect()}
        assert np.abs(np.array([got[i] for i in range(len(seen))]) - want).max() < 1e-9
    short = models[1].upto(2, "z")
    assert len(short.trees) == 2 and short.fit.name == "z"


def test_no_rows_and_one_label(spark):
    df = spark.createDataFrame([(-1, 0, 0, 1, 0.5, 1.0)] * 100, "ctx int, g int, s int, y int, a double, b double")
    fits = [bo.Boost("one", 0, frozenset(), rounds=2), bo.Boost("none", 0, frozenset([0]), rounds=2)]
    models = bo.boosted_fit(df, CUES, fits, mf.group_sums(df, CUES, 1), 1)
    assert all(not t.splits for m in models for t in m.trees) and models[1].start == 0


def test_many_values_share_bins():
    counts = [(-1, 0, 0, c, 3) for c in range(1000)] + [(-1, 1, 0, 5, 9), (2, 0, 0, 7, 1)]
    table = bo.binned(counts, (-1, frozenset([1])), 1)
    assert table.max() == 254 and (np.diff(table[0][:1000].astype(int)) >= 0).all() and np.bincount(table[0][:1000]).max() <= 4


def test_equal_rows_are_read_once(spark):
    df = spark.createDataFrame(sample(), "ctx int, g int, s int, y int, a double, b double")
    seen = [(c, g) for c in (-1, 0) for g in range(3)]
    once, many = (bo.counted(d, CUES, seen).collect() for d in (df, df.crossJoin(spark.range(50)).drop("id")))
    key = lambda rows: {tuple(r[:-1]): r["n"] for r in rows}
    assert len(once) == len(many) and {k: 50 * n for k, n in key(once).items()} == key(many)
    assert sum(key(once).values()) == df.where("g < 3").count()
    assert mf.group_sums(df, CUES, 4).keys == [(c, g) for c in (-1, 0) for g in range(4)]


def test_every_context_scores_its_own_fits(spark):
    """Rows of a context carry scores of the fits that see it, over stored scores of earlier rounds as well."""
    data = sample()
    df = spark.createDataFrame(data, "ctx int, g int, s int, y int, a double, b double").repartition(3).persist()
    fits = [bo.Boost("x", 5, frozenset([1]), rounds=3, min_rows=20), bo.Boost("y", 0, frozenset(), rounds=5, min_rows=20), bo.Boost("z", 0, frozenset([2]), leaves=3, rounds=4, min_rows=20)]
    together = bo.boosted_fit(df, CUES, fits, mf.group_sums(df, CUES, 4), 3, refresh=2)
    for m, f in zip(together, fits):
        want, seen = plain(data, f)
        rows = spark.createDataFrame([(i, *r) for i, r in enumerate(seen)], "key long, ctx int, g int, s int, y int, a double, b double")
        got = {r["key"]: r["score"] for r in bo.boosted_scores(rows, CUES, [m]).collect()}
        assert np.abs(np.array([got[i] for i in range(len(seen))]) - want).max() < 1e-9


def test_trees_grown_in_tasks_are_those_of_passes(spark, monkeypatch):
    """Size decides who grows the trees of a view: one task, or passes over all of them."""
    data = sample(900)
    df = spark.createDataFrame(data, "ctx int, g int, s int, y int, a double, b double").repartition(3).persist()
    fits = [bo.Boost("x", 0, frozenset(), rounds=5, min_rows=20), bo.Boost("y", 5, frozenset([3]), leaves=3, rounds=3), bo.Boost("z", 0, frozenset([2]), leaves=5, rounds=4, min_rows=20)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "key long, ctx int, g int, s int, y int, a double, b double")
    passes, real, found = [], bo._histograms, []

    def noted(table, cues, symbols, views, *a):
        passes.append(len(views.ctx))
        return real(table, cues, symbols, views, *a)

    monkeypatch.setattr(bo, "_histograms", noted)
    for limit, models in ((1 << 18, 0), (500, 2), (0, 3)):
        monkeypatch.setattr(bo, "NEAR", limit)
        passes.clear()
        grown = bo.boosted_fit(df, CUES, fits, mf.group_sums(df, CUES, 4), 3, refresh=2)
        assert set(passes) == ({models} if models else set()) and [m.fit for m in grown] == fits and [len(m.trees) for m in grown] == [5, 3, 4]
        found.append({(r["key"], r["model"]): r["score"] for r in bo.boosted_scores(rows, CUES, grown).collect()})
    assert len(found[0]) == 3 * len(data) and all(f.keys() == found[0].keys() and max(abs(f[k] - found[0][k]) for k in f) < 1e-9 for f in found)


def test_equal_rows_beyond_one_long_number():
    r = np.random.default_rng(4)
    cols = [(r.integers(0, 3, 400), 1 << 30) for _ in range(5)]
    first, place = bo.equal_rows(cols)
    table = np.column_stack([c for c, _ in cols])
    assert len(first) == len(np.unique(table, axis=0)) and (table[first][place] == table).all()


def test_rows_of_unknown_symbols_are_scored(spark):
    df = spark.createDataFrame(sample(), "ctx int, g int, s int, y int, a double, b double")
    models = bo.boosted_fit(df, CUES, [bo.Boost("x", 0, frozenset(), rounds=3, min_rows=20)], mf.group_sums(df, CUES, 4), 3)
    rows = spark.createDataFrame([(i, s, 0.1, 1.0) for i, s in enumerate((0, None, 2, None))], "key long, s int, a double, b double")
    assert {r["key"] for r in bo.boosted_scores(rows, CUES, models).where("NOT isnan(score)").collect()} == {0, 1, 2, 3}
