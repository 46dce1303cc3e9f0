"""Priors, selection, tests and models on small known cases."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions.inventory import PHONES
from strophe.operators import folds as fo
from strophe.operators import models as mo
from strophe.operators import priors as pr
from strophe.operators import resampling as rs
from strophe.operators import selection as se
from strophe.functions.stats import correlation_struct

CONF = "grp string, source string, op string, alternative string, n long"


def test_balanced_rates_known_case_and_duplication(spark):
    rows = [("A", "K", "SUB", "D", 8), ("A", "K", "OK", "K", 92), ("B", "K", "SUB", "T", 1), ("B", "K", "OK", "K", 1)]
    groups = spark.createDataFrame([("A",), ("B",)], "grp string")
    for factor in (1, 7):
        conf = spark.createDataFrame([(*r[:4], r[4] * (factor if r[0] == "A" else 1)) for r in rows], CONF)
        rate = {r["alternative"]: r["rate"] for r in pr.balanced_rates(conf, groups).collect()}
        assert rate == pytest.approx({"T": 0.25, "D": 0.04})
    top = pr.topk_neighbors(pr.balanced_rates(conf, groups), k=1).collect()
    assert [(r["source"], r["alternative"]) for r in top] == [("K", "T")]


def test_distance_prior_and_short_list(spark):
    p = pr.distance_prior(spark).persist()
    assert p.count() == 39 * 39
    sums = p.groupBy("source").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    w = {(r["source"], r["alternative"]): r["p"] for r in p.where("source = 'T'").collect()}
    assert w["T", "D"] / w["T", "<DEL>"] == pytest.approx(math.exp(-0.4) * 1.5 / (0.5 * 2.0))
    assert w["T", "K"] / w["T", "<DEL>"] == pytest.approx(math.exp(-1.5 * 3 / 7) * 1.6)
    pruned = pr.prune_renormalize(p, pr.short_list_table(spark)).where("source = 'K'").collect()
    assert {r["alternative"] for r in pruned} == {"G", "T", "<DEL>"} and sum(r["p"] for r in pruned) == pytest.approx(1)


def test_directed_graph(spark):
    g = pr.directed_graph(pr.confusion_edges(spark), pr.projection_table(spark)).persist()
    kept = {(r["s"], r["t"]) for r in g.where("status = 'kept'").collect()}
    assert ("T", "D") in kept and all(a != b for a, b in kept)
    assert {r["source"] for r in g.where("status = 'unmapped'").collect()} == {"n̩"}
    assert g.where("status = 'self'").count() > 0 and not any(s in ("HH", "EY") for s, _ in kept)


def test_prior_replacement_is_identity_for_the_generic_prior(spark):
    parts = [0.0] * 39
    parts[3], parts[7] = 0.06, 0.04
    ev = spark.createDataFrame([("AA", 0.8, 0.1, 0.1, parts, [1]), ("AA", 0.8, 0.1, 0.1, parts, [1, 12])], "source string, ok double, sub double, del double, "
                               "sub_parts array<double>, accepted array<int>")
    generic = spark.createDataFrame([("AA", 0.9, 0.07, 0.03, [0.0] + [1 / 38] * 38)], "source string, op_ok double, op_sub double, op_del double, sub_p array<double>")
    for r in pr.prior_replacement(ev, generic).collect():
        assert r["cf_ok"] == pytest.approx(0.8) and r["cf_del"] == pytest.approx(0.1) and r["cf_sub"][3] == pytest.approx(0.06)


def test_correlations_against_definitions(spark):
    rng = random.Random(1)
    x = [float(rng.randint(0, 3)) for _ in range(12)]
    y = [a + rng.randint(0, 2) for a in x]
    r = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(correlation_struct(F.col("x"), F.col("y")).alias("c")).first()["c"]
    c = t = u = 0
    for i in range(12):
        for j in range(i):
            c += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            t, u = t + (x[i] != x[j]), u + (y[i] != y[j])
    assert r["tau"] == pytest.approx(c / math.sqrt(t * u)) and r["abs_tau"] == abs(r["tau"])
    assert r["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert r["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    const = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])], "x array<double>, y array<double>")
    assert const.select(correlation_struct(F.col("x"), F.col("y")).alias("c")).first()["c"]["tau"] is None


def test_sign_flip_exact_and_limited(spark):
    d = [0.3, 0.1, 0.25, -0.05, 0.2]
    df = spark.createDataFrame([(f"g{i}", v) for i, v in enumerate(d)], "grp string, d double")
    r = rs.sign_flip_test(df, "grp", "d").first()
    obs = abs(sum(d) / 5)
    null = [abs(sum(v * (1 if p >> i & 1 else -1) for i, v in enumerate(d)) / 5) for p in range(32)]
    assert r["n_permutations"] == 32 and r["p_two_sided"] == pytest.approx(sum(v >= obs - 1e-12 for v in null) / 32)
    with pytest.raises(Exception, match="limited to 20"):
        rs.sign_flip_test(spark.range(21).select(F.col("id").cast("string").alias("grp"), F.lit(1.0).alias("d")), "grp", "d").collect()


def test_weights_and_round_robin(spark):
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 9), ("c", 10), ("c", 11)], "grp string, key long")
    w = fo.group_weights(df, "grp").groupBy("grp").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(3) for r in w)
    pick = [r["grp"] for r in fo.round_robin_sample(df, "grp", "key", 5).orderBy("turn", "grp").collect()]
    assert pick == ["a", "b", "c", "a", "c"]


def test_weighted_quantile_and_threshold_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 7.0)], "v double, w double")
    assert [se.weighted_quantile(df, [], "v", "w", q).first()["quantile"] for q in (0.1, 0.25, 0.3, 0.9)] == [1.0, 3.0, 3.0, 4.0]
    df = spark.createDataFrame([(0.2, 0), (0.9, 1)], "p double, label int")
    assert se.threshold_search(df, [], "p", "label").first()["threshold"] == 0.5


def test_probit_and_rank_normalize(spark):
    ps = [1e-7, 1e-4, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-7]
    out = spark.createDataFrame([(p,) for p in ps], "p double").select("p", mo.probit(F.col("p")).alias("z")).collect()
    for r in out:
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), abs=1e-9)
    train = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 3, 4, 5, 9]], "v double")
    got = {r["v"]: r["z"] for r in mo.rank_normalize(spark.createDataFrame([(x,) for x in (0.0, 2.0, 2.5, 9.0)], "v double"), train, "v", "z", 8).collect()}
    nd = statistics.NormalDist()
    assert got[2.0] == pytest.approx(nd.inv_cdf(2 / 7), abs=1e-6) and got[2.5] == pytest.approx(nd.inv_cdf(3.5 / 7), abs=1e-6)
    assert got[0.0] == pytest.approx(nd.inv_cdf(1e-7), abs=1e-6) and got[9.0] == pytest.approx(-got[0.0], abs=1e-6)


def newton(x, y, w, ridge, intercept=True):
    a = np.c_[x, np.ones(len(x))] if intercept else x
    pen = np.diag([ridge] * x.shape[1] + ([0.0] if intercept else []))
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pen, a.T @ (w * (p - y)) + pen @ b)
    return b


def test_pairwise_fit_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    pts = spark.createDataFrame([(i, "a" if i % 2 else "b", int(v), float(p), float(q)) for i, (v, (p, q)) in enumerate(zip(y, x))], "key long, grp string, y int, f1 double, f2 double")
    pos, neg = np.flatnonzero(y == 1)[:10], np.flatnonzero(y == 0)[:10]
    pairs = spark.createDataFrame([(int(a), int(b), 0.1) for a, b in zip(pos, neg)], "positive long, negative long, weight double")
    coef, icpt = mo.pairwise_rank_fit(pts, pairs, ["f1", "f2"], "grp", "y", 0.05)
    a = np.r_[np.c_[x, np.ones(80)], np.c_[x[pos] - x[neg], np.zeros(10)]]
    t, w, b = np.r_[y, np.ones(10)], np.r_[np.full(80, 1 / 80), np.full(10, 0.05)], np.zeros(3)
    pen = np.diag([0.05, 0.05, 1e-12])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pen, a.T @ (w * (p - t)) + pen @ b)
    assert [*coef, icpt] == pytest.approx(list(b), abs=1e-8)


def test_gmm_density_query_takes_whole_vectors(spark, sf_dir, monkeypatch):
    """All values of an embedding and the operator's own number of components, also where a component has few vectors."""
    import __spark_entry__ as entry

    seen, real = {}, mo.gmm_density

    def noted(train, *a, **k):
        seen.update(k, size=train.selectExpr("min(size(vec))").first()[0])
        return real(train, *a, **k)

    monkeypatch.setattr(mo, "gmm_density", noted)
    out = entry.queries()["gmm_density"](spark, sf_dir)
    full = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert seen["size"] == full.selectExpr("max(size(embedding))").first()[0] > 4 and seen.get("components", 32) == 32
    assert out.where("density IS NOT NULL AND NOT isnan(density)").count() == full.count()


def test_boosted_fit_query_grows_all_trees(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from strophe.operators import boosting as bo

    seen, real = [], bo.boosted_fit

    def noted(*a, **k):
        seen.extend(real(*a, **k))
        return seen

    monkeypatch.setattr(bo, "boosted_fit", noted)
    assert entry.queries()["boosted_fit"](spark, sf_dir).count() > 0
    assert [len(m.trees) for m in seen] == [60] and 1 < max(len(t.values) for t in seen[0].trees) <= 8


def test_gmm_density_of_two_clusters(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(100, 2)) - 20, rng.normal(size=(100, 2)) + 20]
    v = np.r_[parts[0], parts[1]]
    df = spark.createDataFrame([(i, 1, [float(a), float(b)]) for i, (a, b) in enumerate(v)], "key long, s int, vec array<double>")
    out = {r["key"]: r["density"] for r in mo.gmm_density(df, df, "s", "vec", "key", [1], components=2).collect()}
    want = []
    for own in parts:
        cov = np.cov(own.T, bias=True) + 1e-5 * np.eye(2)
        d = own - own.mean(axis=0)
        want += list(math.log(0.5) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)) + 2 * math.log(2 * math.pi)))
    assert [out[i] for i in range(200)] == pytest.approx(want, abs=5e-2)


def test_gmm_density_of_long_vectors_in_blocks(spark, monkeypatch):
    """64 values, a symbol dealt into several blocks, another without a mixture: densities of the fitted parameters in plain numpy."""
    rng = np.random.default_rng(7)
    v = [(i, 1 + i % 2, (rng.normal(size=64) * (1 + i % 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame([*v, (900, 9, v[0][2])], "key long, s int, vec array<double>")
    monkeypatch.setattr(mo, "BLOCK", 10)
    rows = mo.gmm_density(df, df, "s", "vec", "key", [1, 2], components=3)
    got = {r["key"]: r["density"] for r in rows.collect()}
    assert set(got) == set(range(90)) and "BroadcastHashJoin" not in rows._jdf.queryExecution().optimizedPlan().toString()
    for s in (1, 2):
        own = [r for r in v if r[1] == s]
        order = sorted(own, key=lambda r: (int(hashlib.md5(f"{s}-{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
        weights, means, covs = mo.mixture_fit(np.array([r[2] for r in order]), 3)
        for key, _, x in own:
            logs = [math.log(z) - 0.5 * ((d := np.array(x) - m) @ np.linalg.solve(c, d) + np.linalg.slogdet(c)[1] + 64 * math.log(2 * math.pi)) for z, m, c in zip(weights, means, covs)]
            assert got[key] == pytest.approx(max(logs) + math.log(sum(math.exp(u - max(logs)) for u in logs)), abs=1e-5)


def test_group_equal_prior_rows_sum_to_one(spark):
    conf = spark.createDataFrame([("a", "K", "SUB", "T", 5), ("a", "K", "OK", "K", 30), ("b", "K", "OK", "K", 10), ("b", "S", "DEL", "<DEL>", 2)], CONF)
    ops, subs = pr.group_equal_prior(conf)
    assert ops.select("source").distinct().count() == len(PHONES)
    assert all(r["s"] == pytest.approx(1) for t in (ops, subs) for r in t.groupBy("source").agg(F.sum("p").alias("s")).collect())
    weak = {r["source"]: r["fallback"] for r in ops.collect()}
    assert not weak["K"] and weak["S"] and weak["AA"]


def test_final_assessment_needs_every_condition(spark):
    cols = "difference double, n_improved int, ci_low double, p_two_sided double"
    ok, bad = (0.02, 6, 0.001, 0.03), (0.02, 6, -0.001, 0.03)
    for verdict, row, want in (("success", ok, True), ("success", bad, False), ("not_met", ok, False)):
        r = rs.final_assessment(spark.createDataFrame([(verdict,)], "verdict string"), spark.createDataFrame([row], cols)).first()
        assert r["supported"] is want
        assert r["wording"].startswith("statistically") == want


def test_normal_cdf_and_halving_against_plain_forms(spark):
    zs = [-9.0, -7.5, -7.0, -3.3, -0.7, 0.0, 1e-9, 0.4, 2.0, 6.9, 7.2, 9.0]
    got = {r["z"]: r["p"] for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", mo.normal_cdf(F.col("z")).alias("p")).collect()}
    assert all(got[z] == pytest.approx(math.erfc(-z / math.sqrt(2)) / 2, rel=1e-9, abs=1e-15) for z in zs)
    r = random.Random(4)
    for points in (1, 2, 7, 8, 256):
        q = sorted(r.randrange(40) / 2 for _ in range(points))
        xs = [i / 4 for i in range(-2, 84)]
        df = spark.createDataFrame([(x, q) for x in xs], "x double, q array<double>")
        counts = df.select("x", *[mo._count_below(F.col("q"), F.col("x"), points, u).alias(n) for u, n in ((False, "b"), (True, "u"))]).collect()
        assert [(c["b"], c["u"]) for c in counts] == [(sum(v < c["x"] for v in q), sum(v <= c["x"] for v in q)) for c in counts]
