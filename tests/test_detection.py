"""Detection metrics against hand values and brute force, with ties and one dominant group."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strophe.functions.scalars import harmonic
from strophe.operators import audits as au
from strophe.operators import detection as det
from strophe.operators import diagnosis as dia
from strophe.operators.prefix import ranks, running_totals


def rows_with_hot_group(n=900, seed=3, levels=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.5 else rng.choice("abcd")
        y = int(rng.random() < 0.3)
        s = rng.randrange(levels) / 7.0 - 2 + y if levels else rng.gauss(y, 1)
        out.append((g, i, y, float(s)))
    return out


def brute_ap(ys, ss):
    ap, prev = 0.0, 0.0
    p = sum(ys)
    for t in sorted(set(ss), reverse=True):
        k = [y for y, s in zip(ys, ss) if s >= t]
        recall = sum(k) / p
        ap += (recall - prev) * sum(k) / len(k)
        prev = recall
    return ap


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y]
    neg = [s for y, s in zip(ys, ss) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def brute_fpr(ys, ss, recall=0.8):
    """Lowest FPR on the ROC curve after collinear points are dropped."""
    ts = sorted(set(ss), reverse=True)
    tps = [sum(y for y, s in zip(ys, ss) if s >= t) for t in ts]
    fps = [sum(1 - y for y, s in zip(ys, ss) if s >= t) for t in ts]
    keep = [i for i in range(len(ts)) if i in (0, len(ts) - 1)
            or tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]]
    return min(fps[i] / fps[-1] for i in keep if tps[i] / tps[-1] >= recall)


@pytest.mark.parametrize("levels", [0, 3, 40])
def test_ranking_metrics_match_brute_force(spark, levels):
    data = rows_with_hot_group(levels=levels)
    df = spark.createDataFrame(data, "grp string, key long, label int, score double")
    got = {r["grp"]: r for r in det.ranking_metrics(df, ["grp"]).collect()}
    for g in {r[0] for r in data}:
        ys, ss = zip(*[(r[2], r[3]) for r in data if r[0] == g])
        assert got[g]["ap"] == pytest.approx(brute_ap(ys, ss), abs=1e-12)
        assert got[g]["auroc"] == pytest.approx(brute_auc(ys, ss), abs=1e-12)
        assert got[g]["fpr_at_recall"] == pytest.approx(brute_fpr(ys, ss), abs=1e-12)


def test_perfect_ranking_and_single_class(spark):
    df = spark.createDataFrame([("a", 0, .1), ("a", 0, .2), ("a", 1, .8), ("a", 1, .9), ("b", 0, .3), ("b", 0, .4)], "grp string, label int, p double")
    got = {r["grp"]: r for r in det.ranking_metrics(df, ["grp"], "p").join(det.probability_metrics(df, ["grp"], "p"), "grp").collect()}
    assert got["a"]["ap"] == 1 and got["a"]["auroc"] == 1 and got["a"]["brier"] == pytest.approx(0.025)
    assert got["b"]["ap"] is None and got["b"]["auroc"] is None and got["b"]["fpr_at_recall"] is None
    macro = det.macro_average(det.ranking_metrics(df, ["grp"], "p"), [], ["ap"]).first()
    assert (macro["ap_macro"], macro["ap_groups"], macro["ap_strict"]) == (1.0, 1, None)


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 31, 32, 33, 100, 12345]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", harmonic(F.col("n")).alias("h"))
    for r in df.collect():
        assert r["h"] == pytest.approx(sum(1.0 / i for i in range(1, r["n"] + 1)), abs=1e-12)


def test_risk_curves(spark):
    data = [("g", i, y, p, p >= .5) for i, (y, p) in enumerate([(1, .9), (0, .9), (0, .1), (1, .4), (0, .6), (1, .55), (0, .45), (1, .9)])]
    df = spark.createDataFrame(data, "grp string, key long, label int, p double, pred boolean")
    order = sorted(data, key=lambda r: (-abs(r[3] - .5), r[1]))
    cum, risks = 0, []
    for k, r in enumerate(order, 1):
        cum += int((r[3] >= .5) != r[2])
        risks.append(cum / k)
    assert det.risk_coverage(df, ["grp"], "p", "label", "key").first()["aurc"] == pytest.approx(sum(risks) / len(risks))
    # Expected risk over every order of the ties.
    conf = lambda r: r[3] if r[4] else 1 - r[3]
    groups = [list(g) for _, g in itertools.groupby(sorted(data, key=lambda r: -conf(r)), key=conf)]
    totals, n = [0.0] * len(data), 0
    for perm in itertools.product(*[list(itertools.permutations(g)) for g in groups]):
        n += 1
        seq, cum = [r for g in perm for r in g], 0
        for k, r in enumerate(seq):
            cum += int(r[4] != bool(r[2]))
            totals[k] += cum / (k + 1)
    risk = [t / n for t in totals]
    area = sum((a + b) / 2 for a, b in zip([0, *risk], risk)) / len(data)
    got = det.tie_aware_risk(df, ["grp"], "p", "pred", "label").first()
    assert got["aurc"] == pytest.approx(area)
    assert got["risk_100"] == pytest.approx(risk[-1]) and got["risk_050"] == pytest.approx(risk[3])


def test_matched_fpr_has_exactly_the_target(spark):
    data = rows_with_hot_group(400, 5, 6)
    full = [(*r, r[1] % 5 != 0, "substitution" if r[2] else "match", "x" if r[2] else "t",
             "substitution" if r[1] % 3 else "deletion", "x" if r[1] % 2 else "y") for r in data]
    df = spark.createDataFrame(full, "grp string, key long, label int, score double, stable_event boolean, gold_event string, "
                                     "realized string, cand_event string, cand_symbol string")
    out = det.matched_fpr_diagnosis(df, ["grp"], targets=(0.05, 0.3, 1.0)).collect()
    assert all(r["achieved_fpr"] == pytest.approx(r["target_fpr"]) for r in out)
    for r in out:
        own = [x for x in full if x[0] == r["grp"]]
        budget, above, normals = r["target_fpr"] * sum(not x[2] for x in own), 0, [x for x in own if not x[2]]
        for t in sorted({x[3] for x in normals}, reverse=True):
            c = sum(x[3] == t for x in normals)
            if above + c >= budget:
                w = [1.0 if x[3] > t else (budget - above) / c if x[3] == t else 0.0 for x in own]
                break
            above += c
        if r["target_fpr"] == 1.0:
            w = [1.0] * len(own)
        if r["kind"] == "substitution":
            tp = sum(v for v, x in zip(w, own) if x[4] and x[5] == x[7] == "substitution" and x[8] == x[6])
            assert r["true_positives"] == pytest.approx(tp)


def test_prefix_totals_and_ranks_in_a_huge_tie(spark):
    n = 3000
    df = spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, F.col("id") / 7.0).otherwise(1.0).alias("s"))
    got = {r["key"]: r["rank"] for r in ranks(df, ["grp"], "s", "key").collect()}
    order = sorted(range(n), key=lambda i: (-(i / 7.0 if i % 10 == 0 else 1.0), i))
    assert got == {k: i + 1 for i, k in enumerate(order)}
    cells = df.groupBy("grp", "s").agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(cells, ["grp"], "s", ["n"], descending=False).orderBy("s").collect()
    total = 0
    for r in run:
        total += r["n"]
        assert r["cum_n"] == total and r["tot_n"] == n


def test_close_values_are_cut_into_bounded_parts(spark):
    """A million distinct scores in [0.999, 1) and ids above 10^15 do not share a part."""
    from strophe.operators.prefix import digits

    n = 1_000_000
    df = spark.range(n).select((F.lit(0.999) + F.col("id") / (n * 1001.0)).alias("p"), (F.col("id") + 10 ** 15).alias("key"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"))
    for column, bound in (("p", 50), ("key", 1 << 21)):
        parts = df.select(digits(df, column)["_high"].alias("h"), digits(df, column)["_low"].alias("l")).groupBy("h", "l").count()
        assert parts.agg(F.max("count")).first()[0] <= bound
    assert df.select(digits(df, "name")["_high"].alias("h"), digits(df, "name")["_low"].alias("l")).groupBy("h", "l").count().agg(F.max("count")).first()[0] <= 1000


def test_order_code_is_monotone(spark):
    import itertools
    import random

    from strophe.functions.scalars import order_code

    r = random.Random(8)
    values = sorted([0.0, -0.0, 1.0, 2.0, 0.5, -1.0, 1e-310, 5e-324, 1.7e308, -1.7e308, float("inf"), 1 - 2 ** -53, 1 + 2 ** -52, *[r.choice((-1, 1)) * 2.0 ** r.uniform(-900, 900) for _ in range(500)],
                     *[2.0 ** k for k in range(-60, 60)], *[2.0 ** k * (1 - 2 ** -53) for k in range(-60, 60)]])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", order_code(F.col("v")).alias("c")).orderBy("i").collect()
    assert all(a["c"] <= b["c"] for a, b in itertools.pairwise(rows)) and len({x["c"] for x in rows}) > 600


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_errors(spark, bad):
    df = spark.createDataFrame([("g", 1, 0.5, 1), ("g", 2, bad, 0), ("g", 3, 0.25, 0)], "grp string, key long, s double, y int")
    with pytest.raises(Exception, match="null or NaN in s"):
        ranks(df, ["grp"], "s", "key").collect()


def test_ranks_with_text_keys_and_large_ids(spark):
    rows = [("g", f"name{i % 7}-{i:05d}", 10 ** 15 + 3 * i, float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "grp string, name string, key long, s double")
    for c, at in (("name", 1), ("key", 2)):
        want = {r[at]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[at])))}
        assert {r[c]: r["rank"] for r in ranks(df, ["grp"], "s", c).collect()} == want


def test_every_pair_can_be_drawn(spark):
    """Strips cover the pair space: with as many strips as pairs every pair is drawn once."""
    from strophe.operators.linking import pair_sample

    df = spark.createDataFrame([("g", i, int(i < 7)) for i in range(18)], "grp string, key long, y int")
    got = {(r["positive"], r["negative"]) for r in pair_sample(df, "grp", "key", "y", cap=77).collect()}
    assert len(got) == 77
    some = pair_sample(df, "grp", "key", "y", cap=10).collect()
    at = sorted(r["positive"] * 11 + r["negative"] - 7 for r in some)
    assert len(at) == 10 and all(7 * i + min(i, 7) <= x < 7 * (i + 1) + min(i + 1, 7) for i, x in enumerate(at))


def test_exact_quantiles(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    v = rng.normal(size=501).round(1)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for r in au.exact_quantiles(df, [], "v", [0, .05, .5, .95, 1]).collect():
        assert r["value"] == pytest.approx(float(np.quantile(v, r["prob"])))


def test_order_of_rows_does_not_matter(spark):
    data = rows_with_hot_group(200, 9, 5)
    one = spark.createDataFrame(data, "grp string, key long, label int, score double")
    two = spark.createDataFrame(data[::-1], "grp string, key long, label int, score double").repartition(7)
    a = sorted(map(tuple, det.ranking_metrics(one, ["grp"]).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in sorted(map(tuple, det.ranking_metrics(two, ["grp"]).collect()))]


def test_retention_of_candidates(spark):
    rows = [("a", True, "substitution", ["k"], ["t"], "d", False, 1), ("a", True, "substitution", ["k"], ["t"], "d", True, 1), ("a", True, "match", [], ["t"], "t", False, 0)]
    df = spark.createDataFrame(rows, "grp string, stable_event boolean, gold_event string, allowed array<string>, accepted array<string>, "
                                     "realized string, predicted boolean, gold_error int")
    r = dia.candidate_retention(df, ["grp"], "allowed", "accepted").first()
    assert (r["n_substitutions"], r["retained"], r["missing"], r["missing_fnr"]) == (2, 0, 2, 0.5)
