"""Leave-one-group-out runs: prepare, fit on training, choose and calibrate on development, predict test.

All folds and candidates of a run are fitted together: priors, scalers and weights of a fold are totals minus what it
leaves out (``priors.leave_out_prior``, ``manyfit``), and every pass over the rows serves all models.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.inventory import PHONES, strings
from strophe.functions.scalars import log_ratio, signed_log
from strophe.operators import boosting as bo
from strophe.operators import calibration as ca
from strophe.operators import manyfit as mf
from strophe.operators import models as mo
from strophe.operators import priors as pr
from strophe.operators import selection as se
from strophe.operators.audits import table_fingerprint
from strophe.operators.detection import ranking_metrics
from strophe.session import stored

CUES = ("x1", "x2", "x3", "x4")
# The registered candidates, in the order that decides ties.
CANDIDATES = ({"family": "logistic", "C": 0.01}, {"family": "logistic", "C": 0.1}, {"family": "logistic", "C": 1.0}, {"family": "logistic", "C": 10.0},
              {"family": "histogram", "leaves": 4, "iterations": 60}, {"family": "histogram", "leaves": 8, "iterations": 60},
              {"family": "histogram", "leaves": 4, "iterations": 120}, {"family": "histogram", "leaves": 8, "iterations": 120})
#: Evidence as it is, and evidence under the prior that a fold learns.
STRATEGIES = ("evidence", "learned_prior")
LABELLED = "quality IS NULL AND diagnostic AND stable_error"
PLAIN = 1_000_000


@dataclass(frozen=True)
class Fold:
    """Groups of one fold; ``out`` is every group that training must not see."""

    number: int
    cohort: str
    test: str
    dev: str
    train: tuple[str, ...]
    out: frozenset[str]


def cyclic(groups: Sequence[tuple[str, str]]) -> list[Fold]:
    """Every group of a cohort (cohort, group) is tested once; the next one of its cohort is the development group. Cohorts of fewer than
    three groups can't be split and have no folds."""
    everyone, out = {g for _, g in groups}, []
    for cohort in sorted({c for c, _ in groups}):
        own = sorted(g for c, g in groups if c == cohort)
        for i, test in enumerate(own if len(own) > 2 else []):
            dev = own[(i + 1) % len(own)]
            train = tuple(g for g in own if g not in (test, dev))
            out.append(Fold(len(out), cohort, test, dev, train, frozenset(everyone - set(train))))
    return out


def symbol_code(source: Column) -> Column:
    return F.array_position(strings(list(PHONES)), source).cast("int") - 1


def learned_cues(data: DataFrame, conf: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows of ``data`` once per fold of their cohort (``fold``), with the posterior cues under the prior of that fold.

    Training rows use the prior without their own group as well, so no row sees labels of its group.
    """
    spark = data.sparkSession
    outs: dict[frozenset[str], int] = {}
    uses = []
    for f in folds:
        for g in (f.test, f.dev, *f.train):
            uses.append((f.number, g, outs.setdefault(f.out | {g}, len(outs))))
    contexts = spark.createDataFrame([(c, g) for out, c in outs.items() for g in sorted(out)], "ctx int, grp string")
    arrays = stored(pr.prior_arrays(*pr.leave_out_prior(conf, contexts), by=["ctx"]), "fold-priors")
    own = pr.with_open_parts(data).drop("sub_parts")
    rows = own.join(F.broadcast(spark.createDataFrame(uses, "fold int, grp string, ctx int")), "grp")
    changed = pr.replaced_mass(rows, arrays, ["ctx", "source"])
    return changed.withColumns({"x3": signed_log(log_ratio(F.col("cf_mass"), F.col("cf_ok"))), "x4": signed_log(log_ratio(F.col("cf_del"), F.col("cf_ok")))})


def prepared(data: DataFrame, conf: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """(ctx, g, s, y, cues, key, labelled): all rows of both strategies; plain rows stand once, learned ones per fold."""
    codes = {g: i for i, g in enumerate(sorted({g for f in folds for g in (f.test, f.dev, *f.train)}))}
    code = data.sparkSession.createDataFrame(list(codes.items()), "grp string, g int")
    d = data.join(F.broadcast(code), "grp")
    shown = [F.col("g"), symbol_code(F.col("source")).alias("s"), F.col("gold_error").cast("int").alias("y"), *CUES, "key", F.coalesce(F.expr(LABELLED), F.lit(False)).alias("labelled")]
    plain = d.select(F.lit(PLAIN).alias("ctx"), *shown)
    return stored(plain.unionByName(learned_cues(d, conf, folds).select(F.col("fold").alias("ctx"), *shown)), "fold-rows")


def fit_all(rows: DataFrame, fits: Sequence[tuple[str, int, frozenset[int]]], candidates: Sequence[dict], groups: int, cues: Sequence[str] = CUES,
            interactions: bool = True) -> tuple[list[mf.Linear], list[bo.Boosted]]:
    """Every candidate of every (name, ctx, out), named ``name|position``. Boosted candidates that differ in rounds only share their trees."""
    sums = mf.group_sums(rows, cues, groups)
    linear = [mf.Fit(f"{n}|{i}", ctx, out, c["C"], interactions) for n, ctx, out in fits for i, c in enumerate(candidates) if c["family"] == "logistic"]
    grown: dict[tuple, int] = {}
    for c in candidates:
        if c["family"] == "histogram":
            grown[c["leaves"]] = max(grown.get(c["leaves"], 0), c["iterations"])
    boosts = [bo.Boost(f"{n}|{leaves}", ctx, out, leaves, rounds) for n, ctx, out in fits for leaves, rounds in grown.items()]
    models = {m.fit.name: m for m in (bo.boosted_fit(rows, cues, boosts, sums, len(PHONES)) if boosts else [])}
    trees = [models[f"{n}|{c['leaves']}"].upto(c["iterations"], f"{n}|{i}") for n, _, _ in fits for i, c in enumerate(candidates) if c["family"] == "histogram"]
    return (mf.fit_logistic(rows, cues, linear, sums, len(PHONES)) if linear else []), trees


def scored_by(rows: DataFrame, linear: Sequence[mf.Linear], trees: Sequence[bo.Boosted], cues: Sequence[str] = CUES) -> DataFrame:
    """(key, model, score) of rows that carry ``name``: under every given model of that name."""
    spark = rows.sparkSession
    parts = []
    if linear:
        table = mf.linear_table(spark, linear).withColumn("name", F.substring_index("model", "|", 2))
        parts.append(rows.join(F.broadcast(table), ["name", "s"]).select("key", "model", mf.linear_score(cues).alias("score")))
    if trees:
        parts.append(bo.boosted_scores(rows, cues, trees, on="name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_folds(data: DataFrame, conf: DataFrame, folds: Sequence[Fold], candidates: Sequence[dict] = CANDIDATES,
              strategies: Sequence[str] = STRATEGIES) -> tuple[DataFrame, DataFrame]:
    """Test predictions of all folds and strategies without gold columns, and what each chose.

    ``data``: evidence rows of both labelled and other positions with cues; ``conf``: confusion counts by ``grp``. Labels of a test group never reach
    a fit, a scaler, a prior, the candidate choice (development average precision, ties to the earlier candidate) or the calibration.
    """
    spark = data.sparkSession
    codes = {g: i for i, g in enumerate(sorted({g for f in folds for g in (f.test, f.dev, *f.train)}))}
    rows = prepared(data, conf, folds)
    names = [(f"{f.number}|{s}", PLAIN if s == STRATEGIES[0] else f.number, frozenset(codes[g] for g in f.out if g in codes)) for f in folds for s in strategies]
    linear, trees = fit_all(rows.where("labelled").drop("labelled"), names, candidates, len(codes))
    part = spark.createDataFrame([(ctx, codes[g], f"{f.number}|{s}", role) for f in folds for s in strategies for g, role in ((f.dev, "dev"), (f.test, "test"))
                                  for ctx in [PLAIN if s == STRATEGIES[0] else f.number]], "ctx int, g int, name string, role string")
    used = stored(rows.join(F.broadcast(part), ["ctx", "g"]), "fold-scored")
    dev = used.where("role = 'dev' AND labelled")
    trials = stored(scored_by(dev, linear, trees).join(dev.select("key", "name", "y"), on="key").where(F.col("name") == F.substring_index("model", "|", 2)), "fold-trials")
    ap = {r["model"]: r["ap"] for r in ranking_metrics(trials, ["model"], "score", "y").collect()}  # folds x strategies x candidates
    best = {n: max(range(len(candidates)), key=lambda i: (round(ap.get(f"{n}|{i}") if ap.get(f"{n}|{i}") is not None else -1.0, 12), -i)) for n, _, _ in names}
    picked = [f"{n}|{i}" for n, i in best.items()]
    mine = trials.where(F.col("model").isin(picked))
    maps = ca.platt_many(mine, ["name"], "score", "y").drop("variant")
    cut = se.threshold_search(mine.join(F.broadcast(maps), "name").withColumn("p_error", F.expr("1 / (1 + exp(-(slope * score + intercept)))")), ["name"], "p_error", "y")
    choice = spark.createDataFrame([(n, i, ap.get(f"{n}|{i}")) for n, i in best.items()], "name string, candidate int, dev_ap double")
    fold_info = spark.createDataFrame([(f"{f.number}|{s}", f.test, f.cohort, s) for f in folds for s in strategies], "name string, fold string, cohort string, strategy string")
    chosen = fold_info.join(choice, "name").join(maps, "name").join(cut.select("name", "threshold", "f1"), "name")
    chosen = stored(chosen, "fold-choices")
    scores = scored_by(used.where("role = 'test'"), [m for m in linear if m.fit.name in picked], [m for m in trees if m.fit.name in picked])
    scores = scores.withColumn("name", F.substring_index("model", "|", 2)).join(F.broadcast(chosen.drop("cohort")), "name")
    known = with_candidates(data.select("key", "event", "idx", "grp", "cohort", "source", "ok", "sub", "del"))
    out = mo.apply_calibration(scores.join(known, "key"), "score", F.col("slope"), F.col("intercept"), F.col("threshold"))
    return out.select("cohort", "fold", "strategy", "key", "event", "idx", "grp", "source", "score", "p_error", "predicted", "status"), chosen.drop("name")


def with_candidates(df: DataFrame) -> DataFrame:
    """Candidate event by the larger posterior, so a status text can be given."""
    if "cand_event" in df.columns:
        return df
    return df.withColumns({
        "cand_event": F.when(F.col("sub") >= F.col("del"), "substitution").otherwise("deletion"),
        "cand_conf": F.greatest("sub", "del") / (F.col("sub") + F.col("del")), "cand_margin": F.abs(F.col("sub") - F.col("del"))})


COMPACT = ("x_score", "x_best", "x_sub", "x_del", "x_occurrence", "x_identity", "x_b1", "x_b2", "x_b3")
# Candidates of the inner choice.
INNER = ({"family": "logistic", "C": 0.1}, {"family": "logistic", "C": 1.0})


def inner_rows(data: DataFrame, conf: DataFrame, groups: Sequence[str], baselines: Sequence[str] = ("b1", "b2", "b3")) -> tuple[DataFrame, dict[tuple[str, str], list[str]]]:
    """Rows once per held-out group ``h`` with compact cues, and the groups that the prior of (held, row's group) comes from.

    Two levels are left out: a row of another group uses the prior of all but ``h`` and its own group, a row of ``h`` that of all but ``h``.
    """
    spark, outs, uses, sources = data.sparkSession, {}, [], {}
    for h in groups:
        for g in groups:
            out = frozenset((h, g))
            uses.append((groups.index(h), g, outs.setdefault(out, len(outs))))
            sources[h, g] = [x for x in groups if x not in out]
    contexts = spark.createDataFrame([(c, g) for out, c in outs.items() for g in sorted(out)], "ctx int, grp string")
    arrays = stored(pr.prior_arrays(*pr.leave_out_prior(conf, contexts), by=["ctx"]), "inner-priors")
    sure = stored(pr.leave_out_reliability(conf, contexts).select("ctx", "source", "reliability"), "inner-reliability")
    own = pr.with_open_parts(data).drop("sub_parts")
    rows = own.join(F.broadcast(spark.createDataFrame(uses, "held int, grp string, ctx int")), "grp")
    cues = pr.compact_features(rows, arrays, sure, list(baselines), ["ctx", "source"])
    codes = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "grp string, g int")
    cues = cues.join(F.broadcast(codes), "grp").select(
        F.col("held").alias("ctx"), "g", symbol_code(F.col("source")).alias("s"), F.col("gold_error").cast("int").alias("y"), *COMPACT, "key", "grp")
    return stored(cues, "inner-rows"), sources


def oof_scores(data: DataFrame, conf: DataFrame, groups: Sequence[str], candidates: Sequence[dict] = INNER) -> tuple[DataFrame, dict]:
    """Out-of-fold scores of every candidate by leaving one group out; priors, scalers, weights and models are refitted without it.

    Returns (key, grp, gold_error, held_out, candidate, score, training_prior_sources) and, as a small dict, the choice by the mean average precision over groups.
    ``data`` holds labelled rows only.
    """
    spark, groups = data.sparkSession, sorted(groups)
    rows, sources = inner_rows(data, conf, groups)
    names = [(f"inner|{h}", i, frozenset([i])) for i, h in enumerate(groups)]
    linear, trees = fit_all(rows.drop("grp"), names, candidates, len(groups), COMPACT, interactions=False)
    held = rows.where(F.col("g") == F.col("ctx")).withColumn("name", F.concat(F.lit("inner|"), F.col("grp")))
    scores = scored_by(held, linear, trees, COMPACT).withColumn("candidate", F.substring_index("model", "|", -1).cast("int"))
    listed = spark.createDataFrame([(h, ",".join(sources[h, h])) for h in groups], "grp string, training_prior_sources string")
    out = stored(scores.join(held.select("key", "grp", F.col("y").alias("gold_error")), "key").join(F.broadcast(listed), "grp").select(
        "key", "grp", "gold_error", F.col("grp").alias("held_out"), "candidate", "score", "training_prior_sources"), "inner-scores")
    per = ranking_metrics(out, ["candidate", "grp"], "score", "gold_error").groupBy("candidate").agg(F.avg("ap").alias("ap")).collect()
    best = max(per, key=lambda r: (round(r["ap"] if r["ap"] is not None else -1.0, 12), -r["candidate"]))
    return out, {"candidate": best["candidate"], "inner_macro_ap": best["ap"]}


# --- frozen predictions ------------------------------------------------------------------------

PARTS = ("cohort", "fold", "strategy")


def freeze(predictions: DataFrame, path: str, cols: Sequence[str], parts: Sequence[str] = ()) -> None:
    """Write predictions partitioned by ``parts``, then a manifest with one fingerprint per part.

    Fingerprints cover every column. Tables with gold columns are refused. The manifest is written last, so a half-written
    run has none.
    """
    leaked = [c for c in predictions.columns if c.startswith("gold")]
    if leaked:
        raise ValueError(f"predictions carry gold columns: {leaked}")
    if set(cols) != set(predictions.columns):
        raise ValueError("the fingerprint has to cover every column")
    predictions.write.mode("errorifexists").partitionBy(*parts).parquet(f"{path}/predictions")
    written = predictions.sparkSession.read.schema(predictions.schema).parquet(f"{path}/predictions")
    table_fingerprint(written, cols, parts).write.mode("errorifexists").json(f"{path}/complete")


def load_frozen(spark: SparkSession, path: str, cols: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """Frozen predictions; refuses without a manifest, or when a part has changed, is missing or is new. One aggregate verifies all parts."""
    listed = "".join(f"{p} string, " for p in parts)
    try:
        manifest = spark.read.schema(f"{listed}n_rows bigint, fingerprint string").json(f"{path}/complete").collect()  # a row per part
    except Exception as exc:
        raise FileNotFoundError(f"no completion marker under {path}") from exc
    rows = spark.read.parquet(f"{path}/predictions")
    rows = rows.withColumns({p: F.col(p).cast("string") for p in parts})
    key = lambda r: tuple(r[p] for p in parts)
    want = {key(r): (r["n_rows"], r["fingerprint"]) for r in manifest}
    have = {key(r): (r["n_rows"], r["fingerprint"]) for r in table_fingerprint(rows, cols, parts).collect()}
    wrong = sorted(str(k) for k in want.keys() | have.keys() if want.get(k) != have.get(k))
    if wrong or not want:
        raise ValueError(f"frozen predictions differ from their completion marker: {wrong}")
    return rows
