"""Calibration of many models against a numeric solution."""

from __future__ import annotations

import numpy as np
import pytest

from strophe.operators import calibration as ca
from tests.test_priors_models import newton


def test_all_variants_of_many_models(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for name, slope, shift in (("up", 1.5, 40.0), ("down", -0.7, -3.0)):
        x = rng.normal(size=300) * 5 + shift
        x[:50] = x[50:100]
        y = (rng.random(300) < 1 / (1 + np.exp(-slope * (x - shift) / 5))).astype(float)
        g = rng.choice(["a", "b", "c"], size=300, p=[.7, .2, .1])
        rows += [(name, str(k), float(s), int(v)) for k, s, v in zip(g, x, y)]
        w = np.array([300 / 3 / (g == k).sum() for k in g])
        z = (x - x.mean()) / x.std()
        solve = lambda a, weight, ridge: newton(a[:, None], y, weight, ridge)
        back = lambda b: (b[0] / x.std(), b[1] - b[0] * x.mean() / x.std())
        ridge = back(solve(z, np.ones(300) / 300, 2e-4 / x.std() ** 2))
        want[name, "ridge"] = ridge if ridge[0] >= 0 else (0.0, np.log(y.mean() / (1 - y.mean())))
        want[name, "weighted"] = back(solve(z, w, 1 / x.std() ** 2))
        want[name, "standardized"] = back(solve(z, w, 1.0))
    df = spark.createDataFrame(rows, "m string, grp string, score double, label int").repartition(3)
    got = {(r["m"], r["variant"]): (r["slope"], r["intercept"]) for r in ca.platt_many(df, ["m"], "score", "label", ca.VARIANTS, "grp").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


def test_one_label_and_equal_scores(spark):
    df = spark.createDataFrame([("one", 1.0, 1), ("one", 2.0, 1), ("flat", 5.0, 1), ("flat", 5.0, 0), ("flat", 5.0, 0)], "m string, score double, label int")
    got = {r["m"]: (r["slope"], r["intercept"]) for r in ca.platt_many(df, ["m"], "score", "label").collect()}
    assert np.isfinite([*got["one"], *got["flat"]]).all()
    assert got["flat"][0] * 5 + got["flat"][1] == pytest.approx(np.log(0.5), abs=1e-6)
