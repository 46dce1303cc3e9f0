"""Exact spectra against numpy and sympathetic cases, whitening against a plain computation."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strophe.llm import exact_spectrum as es
from strophe.llm import whitening


def charpoly(m):
    """Faddeev-LeVerrier in fractions, lowest coefficient first."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[-1] if i == j else 0) * 1 for j in range(d)] for i in range(d)]
        mb = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(mb[i][i] for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def gram(rows):
    return [[sum(a * b for a, b in zip(x, y)) for y in zip(*rows)] for x in zip(*rows)]


@pytest.mark.parametrize("d", [1, 2, 3, 5, 8])
def test_polynomial_and_roots(d):
    r = random.Random(d)
    for rank in (d, max(1, d - 2)):
        m = gram([[r.randint(-900, 900) for _ in range(d)] for _ in range(rank)])
        moduli = es.primes(2 * es.coefficient_bound(m))
        poly = es.from_residues(moduli, [es.residue(m, p) for p in moduli])
        assert poly == charpoly(m)
        want = sorted(np.linalg.eigvalsh(np.array(m, dtype=float)), reverse=True)
        got = list(es.components(m, poly, 4))
        assert len(got) == min(rank, 4)
        for (value, v), w in zip(got, want):
            assert float(value) == pytest.approx(w, rel=1e-9)
            x = np.array([float(e) for e in v])
            assert np.abs(np.array(m, dtype=float) @ x - float(value) * x).max() <= 1e-9 * float(value)


def test_equal_and_whole_eigenvalues():
    m = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 9, 0], [0, 0, 0, 4]]
    poly = charpoly(m)
    got = list(es.components(m, poly, 4))
    assert [round(float(v), 20) for v, _ in got] == [9, 4, 4, 4]
    axes = np.array([[float(e) for e in v] for _, v in got])
    assert np.abs(axes @ axes.T - np.eye(4)).max() < 1e-15
    assert es.roots_above(poly, 4, 0) == 1 and es.roots_above(poly, 7, 1) == 4 and es.roots_above(poly, 9, 0) == 0


def test_close_eigenvalues():
    """A gap of 1e-12 of the value: vectors stay exact where double precision alone mixes them."""
    big = 10 ** 12
    m = [[big + 1, 0, 0], [0, big, 0], [0, 0, 7]]
    vectors = [[float(e) for e in v] for _, v in es.components(m, charpoly(m), 3)]
    assert np.abs(np.array(vectors) - np.eye(3)).max() < 1e-15


def test_primes():
    assert [n for n in range(60) if es.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert es.primes(1)[0] == 2147483647


SCHEMA = "vec_id long, embedding array<float>, n int, component string, x double, _key int"


def rows_of(vectors):
    return [(i, v, 3, "c", 0.5, 9) for i, v in vectors]


def check(spark, vectors, count=4):
    usable = [(i, v) for i, v in vectors if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    matrix = gram([[n * c - s for c, s in zip(x, sums)] for x in fit])  # n times the scatter
    out = whitening.whitened(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3), count=count).collect()
    values = np.linalg.eigvalsh(np.array(matrix, dtype=float))[::-1]
    k = min(count, int((values > 1e-9 * values[0]).sum()))
    assert len(out) == k * len(usable)
    exact = {}
    for i, x in whole:
        exact.setdefault(i, []).append(sum((n * c - s) ** 2 for c, s in zip(x, sums)))
    for r in out:
        assert r["n"] == n and int(r["deviation"]) in exact[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-10
    return out


def test_whitening(spark):
    r = random.Random(3)
    v = [(i, [r.gauss(0, 1 + j) for j in range(6)]) for i in range(60)]
    v += [(100, v[0][1]), (0, v[0][1]), (None, v[1][1]), (101, None), (102, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, []), (106, [1.0])]
    out = check(spark, v)
    pairs = [(a["whitened"], b["whitened"]) for a in out for b in out if a["vec_id"] == 0 and b["vec_id"] == 100 and a["component"] == b["component"]]
    assert pairs and all(a == b for a, b in pairs)


def test_low_rank_and_empty(spark):
    check(spark, [(i, [float(i), 2.0 * i, 1.0, 1.0, 1.0, 1.0]) for i in range(5)])
    one = spark.createDataFrame(rows_of([(1, [0.5] * 6), (2, [0.5] * 6)]), SCHEMA)
    assert whitening.whitened(one).count() == 0
    out = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_in_any_range():
    r = random.Random(9)
    for top, n in ((50, 40), (3000, 10 ** 9), (10 ** 12, 10 ** 6)):
        x = np.array([[r.randint(-top, top) for _ in range(4)] for _ in range(5)])
        model = whitening.Whitening(n, [r.randint(-n * top, n * top) for _ in range(4)], np.zeros((4, 1)), [1.0])
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
        assert [int(v) for v in whitening._deviations(x, model)] == want


def test_large_entries(spark):
    """Sums of products beyond a long stay exact."""
    r = random.Random(5)
    check(spark, [(i, [r.uniform(-1, 1) * 10 ** 7 for _ in range(6)]) for i in range(20)])


def test_axes_fit_exact_ones(spark, sf_dir):
    """Whitened values of the given table against vectors from numpy, up to sign."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.floor(np.stack([np.asarray(r["embedding"], dtype=np.float64) for r in df.collect()]) * 256)
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened(df).collect()}
    ids = [r["vec_id"] for r in df.collect()]
    for c in range(1, 5):
        want = (x - fit.mean(axis=0)) @ vectors[:, -c] / math.sqrt(values[-c])
        have = np.array([got[(i, c)] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
