"""Rank correlations and the exact swap test against brute force."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from strophe.operators import association as ac
from strophe.operators import resampling as rs


def sign(v):
    return (v > 0) - (v < 0)


def tau(x, y):
    pairs = list(itertools.combinations(range(len(x)), 2))
    s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)
    tx, ty = sum(x[i] != x[j] for i, j in pairs), sum(y[i] != y[j] for i, j in pairs)
    return s / math.sqrt(tx * ty) if tx and ty else None


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def ranks(x):
    return [sum(u < v for u in x) + (sum(u == v for u in x) + 1) / 2 for v in x]


def test_correlations_of_positions(spark):
    r = random.Random(8)
    data = [("hot", float(r.randrange(12)), r.choice([-1.5, 0.0, 0.25, r.random() * 9])) for _ in range(260)]
    data += [("ties", 1.0 + i % 2, float(i % 3)) for i in range(30)] + [("near", 1.0 + i * 1e-13, -1e9 + i * (-1) ** i) for i in range(20)]
    data += [("flat", 3.0, float(i)) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 3.0), ("same", 2.0, 2.0), ("same", 2.0, 2.0), ("same", 5.0, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(4)
    got = {row["g"]: row for row in ac.correlations(df, ["g"], "x", "y").collect()}
    for g in ("hot", "ties", "near", "same"):
        x, y = [d[1] for d in data if d[0] == g], [d[2] for d in data if d[0] == g]
        assert got[g]["n"] == len(x) and got[g]["tau"] == pytest.approx(tau(x, y), abs=1e-12) and got[g]["abs_tau"] == abs(got[g]["tau"])
        assert got[g]["spearman"] == pytest.approx(pearson(ranks(x), ranks(y)), abs=1e-9) and got[g]["pearson"] == pytest.approx(pearson(x, y), abs=1e-4 if g == "near" else 1e-9)
    assert all(got[g][c] is None for g in ("flat", "two") for c in ("tau", "abs_tau", "spearman", "pearson"))
    whole = ac.correlations(df.where("g = 'hot'").drop("g"), [], "x", "y").first()
    assert whole["tau"] == got["hot"]["tau"]
    with pytest.raises(Exception, match="null or NaN"):
        ac.correlations(spark.createDataFrame([(None, 1.0)], "x double, y double"), [], "x", "y").collect()


@pytest.mark.parametrize("n", [3, 5, 8])
def test_swap_test(spark, n):
    r = random.Random(n)
    y, a, b = [float(r.randrange(4)) for _ in range(n)], [float(r.randrange(5)) for _ in range(n)], [r.random() if n == 8 else float(r.randrange(3)) for _ in range(n)]
    a[-1], y[0], y[-1] = 9.0, -1.0, 7.0
    got = {x["metric"]: x for x in rs.method_swap_test(spark.createDataFrame(list(zip(range(n), y, a, b)), "g int, y double, a double, b double"), "g", "y", "a", "b").collect()}
    found = {"tau": [], "abs_tau": []}
    for keep in itertools.product((True, False), repeat=n):
        ta, tb = tau([p if k else q for p, q, k in zip(a, b, keep)], y), tau([q if k else p for p, q, k in zip(a, b, keep)], y)
        ok = ta is not None and tb is not None
        found["tau"].append(ta - tb if ok else None)
        found["abs_tau"].append(abs(ta) - abs(tb) if ok else None)
    for m, v in found.items():
        valid = [x for x in v if x is not None]
        assert got[m]["n_permutations"] == 2 ** n and got[m]["n_groups"] == n
        if v[0] is not None:
            assert got[m]["difference"] == pytest.approx(v[0], abs=1e-12)
            assert got[m]["p_two_sided"] == pytest.approx(sum(abs(x) >= abs(v[0]) - 1e-12 for x in valid) / len(valid))


def test_swap_test_refuses_more_than_twenty_groups(spark):
    df = spark.range(21).selectExpr("id g", "double(id) y", "double(id) a", "double(-id) b")
    with pytest.raises(ValueError, match="20"):
        rs.method_swap_test(df, "g", "y", "a", "b")
