"""Leave-one-group-out runs: priors by subtraction, leaks, choices and frozen predictions."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strophe.operators import priors as pr
from strophe.plans import foldrun as fr
from strophe.plans import q_models as qm
from strophe.plans.q_priors import conf
from strophe.session import shared_dir

SMALL = ({"family": "logistic", "C": 0.1}, {"family": "histogram", "leaves": 3, "iterations": 2}, {"family": "histogram", "leaves": 3, "iterations": 1})


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return qm.cues(spark, sf_dir).persist(), conf(spark, sf_dir)


def test_leave_out_prior_is_the_prior_of_the_rest(spark, inputs):
    _, counts = inputs
    contexts = spark.createDataFrame([(0, "g01"), (1, "g01"), (1, "g05"), (1, "g11"), (2, None), (3, "unknown")], "ctx int, grp string")
    ops, subs = pr.leave_out_prior(counts, contexts)
    sure = pr.leave_out_reliability(counts, contexts)
    for ctx, out in ((0, ["g01"]), (1, ["g01", "g05", "g11"]), (2, []), (3, [])):
        rest = counts.where(~F.col("grp").isin(out)) if out else counts
        want_ops, want_subs = pr.group_equal_prior(rest)
        key = lambda df, *k: {tuple(r[c] for c in k): r for r in df.collect()}
        a, b = key(ops.where(F.col("ctx") == ctx), "source", "op"), key(want_ops, "source", "op")
        assert a.keys() == b.keys() and all(a[k]["p"] == pytest.approx(b[k]["p"], abs=1e-12) and a[k]["fallback"] == b[k]["fallback"] for k in b)
        a, b = key(subs.where(F.col("ctx") == ctx), "source", "target"), key(want_subs, "source", "target")
        assert a.keys() == b.keys() and all(a[k]["p"] == pytest.approx(b[k]["p"], abs=1e-12) for k in b)
        a, b = key(sure.where(F.col("ctx") == ctx), "source"), key(pr.identity_reliability(rest, "grp"), "source")
        assert all(a[k]["reliability"] == pytest.approx(b[k]["reliability"], abs=1e-12) for k in b)


def test_folds_cover_both_cohorts(inputs):
    folds = qm._folds(inputs[0])
    assert [f.test for f in folds] == [f"g{i:02d}" for i in range(12)]
    for f in folds:
        assert f.dev != f.test and f.out | set(f.train) == {f"g{i:02d}" for i in range(12)} and not f.out & set(f.train)
    assert fr.cyclic([("x", "a"), ("x", "b")]) == []


def counted_again(data):
    """Confusion counts of changed labels, from the evidence rows themselves."""
    op = F.when(F.col("gold_error") == 0, "OK").otherwise("SUB")
    alt = F.when(F.col("gold_error") == 0, F.col("source")).otherwise(F.when(F.col("source") == "AA", "AE").otherwise("AA"))
    return data.where("quality IS NULL AND stable_event").groupBy("grp", "cohort", "source", op.alias("op"), alt.alias("alternative")).agg(F.count(F.lit(1)).alias("n"))


def test_labels_of_a_test_group_change_nothing_in_its_fold(inputs):
    data, _ = inputs
    folds = qm._folds(data)
    for test in ("g02", "g09"):
        fold = [f for f in folds if f.test == test]
        flipped = data.withColumn("gold_error", F.when(F.col("grp") == test, 1 - F.col("gold_error")).otherwise(F.col("gold_error")))
        runs = []
        for d in (data, flipped):
            out, chosen = fr.run_folds(d, counted_again(d), fold, SMALL)
            runs.append(([tuple(r) for r in out.select("strategy", "key", F.round("score", 9), F.round("p_error", 9), "status").orderBy("strategy", "key").collect()],
                         chosen.orderBy("strategy").select("strategy", "candidate", F.round("threshold", 9)).collect()))
        assert runs[0] == runs[1] and len(runs[0][0]) == 2 * data.where(F.col("grp") == test).count()


@pytest.mark.parametrize("name", ["fold_run", "freeze_then_evaluate", "fold_pipeline"])
def test_queries_try_every_candidate(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    def noted(rows, fits, candidates, *a, **k):
        raise Seen(fits, candidates)

    monkeypatch.setattr(fr, "fit_all", noted)
    with pytest.raises(Seen) as found:
        entry.queries()[name](spark, sf_dir)
    fits, candidates = found.value.args
    assert len(candidates) == 8 and list(candidates) == list(fr.CANDIDATES) and len(fits) == 12 * len(fr.STRATEGIES)


def test_inner_scores_never_see_their_group(inputs):
    data = inputs[0].where(qm.LABELLED).where("grp IN ('g00', 'g03', 'g08', 'g11')")
    groups = sorted(r[0] for r in data.select("grp").distinct().collect())
    counts = inputs[1].where(F.col("grp").isin(groups))
    out, chosen = fr.oof_scores(data, counts, groups)
    rows = out.select("grp", "held_out", "training_prior_sources").distinct().collect()
    assert len(rows) == len(groups) and all(r["grp"] == r["held_out"] and r["grp"] not in r["training_prior_sources"].split(",") for r in rows)
    assert out.count() == len(fr.INNER) * data.count() and chosen["candidate"] in (0, 1)
    _, sources = fr.inner_rows(data, counts, groups)
    assert all(h not in s and g not in s and len(s) == len(groups) - len({h, g}) for (h, g), s in sources.items())
    g = groups[1]
    flipped = data.withColumn("gold_error", F.when(F.col("grp") == g, 1 - F.col("gold_error")).otherwise(F.col("gold_error")))
    again, _ = fr.oof_scores(flipped, counted_again(flipped), groups)
    same, _ = fr.oof_scores(data, counted_again(data), groups)
    pick = lambda d: {(r["key"], r["candidate"]): round(r["score"], 8) for r in d.where(F.col("grp") == g).collect()}
    assert pick(again) == pick(same)


def test_manifest_refuses_a_changed_missing_or_new_part(spark):
    df = spark.createDataFrame([("case", f"g0{i % 3}", "s", i, 0.1 * i) for i in range(30)], "cohort string, fold string, strategy string, key long, score double")

    def frozen():
        path = f"{shared_dir(spark)}/freeze-{uuid.uuid4().hex}"
        fr.freeze(df, path, df.columns, fr.PARTS)
        return path

    path = frozen()
    assert fr.load_frozen(spark, path, df.columns, fr.PARTS).count() == 30
    assert spark.read.json(f"{path}/complete").count() == 3
    part = df.where("fold = 'g01'").withColumn("score", F.when(F.col("key") == 4, 9.0).otherwise(F.col("score"))).drop("cohort", "fold", "strategy")
    part.write.mode("overwrite").parquet(f"{path}/predictions/cohort=case/fold=g01/strategy=s")
    with pytest.raises(ValueError, match="g01"):
        fr.load_frozen(spark, path, df.columns, fr.PARTS)
    path = frozen()
    part.write.parquet(f"{path}/predictions/cohort=case/fold=g09/strategy=s")
    with pytest.raises(ValueError, match="g09"):
        fr.load_frozen(spark, path, df.columns, fr.PARTS)
    path = frozen()
    part.limit(0).write.mode("overwrite").parquet(f"{path}/predictions/cohort=case/fold=g02/strategy=s")
    with pytest.raises(ValueError, match="g02"):
        fr.load_frozen(spark, path, df.columns, fr.PARTS)


def test_open_parts_are_taken_once_and_change_nothing(spark, inputs):
    data, counts = inputs
    arrays = pr.prior_arrays(*pr.group_equal_prior(counts))
    mass = F.aggregate("cf_sub", F.lit(0.0), lambda a, v: a + v)
    want = {r["key"]: tuple(r)[1:] for r in pr.prior_replacement(data, arrays).select("key", "cf_ok", "cf_del", mass).collect()}
    slim = pr.with_open_parts(data).drop("sub_parts")
    got = {r["key"]: tuple(r)[1:] for r in pr.replaced_mass(slim, arrays).select("key", "cf_ok", "cf_del", "cf_mass").collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-13, abs=1e-15) for k in want)
    assert slim.where(F.size("open_parts") > 2).isEmpty()
