"""Registered queries: feature transforms, detectors, calibration, fusion and fold runs."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strophe.functions.inventory import PHONES
from strophe.operators import calibration as ca
from strophe.operators import detection as det
from strophe.operators import linking as lk
from strophe.operators import models as mo
from strophe.operators import selection as se

from strophe.plans import foldrun as fr
from strophe.plans.q_detection import CURVE
from strophe.plans.q_priors import EVIDENCE_SQL, conf, evidence
from strophe.plans.registry import query, rounded
from strophe.plans.tables import PTOK_SQL, SCORED_SQL, TOKENS_SQL, scored, table, tokens
from strophe.session import shared_dir, stored

LABELLED = "quality IS NULL AND diagnostic AND stable_error"


def cues(spark, sf_dir):
    return mo.score_cues(evidence(spark, sf_dir))


@query("standardize", f"""WITH {TOKENS_SQL}, t AS (SELECT avg(value) m, stddev_pop(value) s, avg(k) mk, stddev_pop(k) sk FROM tokens WHERE cohort = 'case')
SELECT key, round((value - m) / s, 8) + 0.0 AS value, round((k - mk) / sk, 8) + 0.0 AS k FROM tokens, t WHERE cohort = 'control'""")
def standardize(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("k", F.col("k").cast("double"))
    out = mo.standardize(t.where("cohort = 'control'").select("key", "value", "k"), t.where("cohort = 'case'"), ["value", "k"])
    return out.select("key", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("value", "k")])


@query("rank_normalize", f"""WITH {TOKENS_SQL}, q AS (SELECT quantile_cont(value, list_transform(range(0, 256), lambda i: i / 255.0::DOUBLE)) AS q FROM tokens WHERE cohort = 'case'),
x AS (SELECT key, value AS v, q, len(list_filter(q, lambda u: u < value)) AS b, len(list_filter(q, lambda u: u <= value)) AS u FROM tokens, q WHERE cohort = 'control')
SELECT key, round(greatest(1e-7, least(1 - 1e-7, CASE WHEN u = 0 THEN 0 WHEN b >= 256 THEN 1 WHEN u > b THEN (b + u - 1) / 2.0::DOUBLE / 255 ELSE (b - 1 + (v - q[b]) / (q[b + 1] - q[b])) / 255 END)), 7) AS place FROM x""")
def rank_normalize(spark, sf_dir):
    """Place of every value in the training quantiles: the normal score mapped back to (0, 1)."""
    t = tokens(spark, sf_dir).select("key", "cohort", "value")
    out = mo.rank_normalize(t.where("cohort = 'control'"), t.where("cohort = 'case'"), "value", "normal")
    return out.select("key", F.round(mo.normal_cdf(F.col("normal")), 7).alias("place"))


@query("phone_design", f"""WITH {PTOK_SQL}, {EVIDENCE_SQL.split("pa AS")[0].rstrip().rstrip(",")},
x AS (SELECT key, pid, unnest([-gop, -viterbi_gop, ln(sub / ok), ln(del / ok)]) AS v, unnest([0, 1, 2, 3]) AS i FROM ev), y AS (SELECT key, pid, i, round(sign(v) * ln(1 + abs(v)), 8) + 0.0 AS v FROM x),
z AS (SELECT key, i AS slot, v AS value FROM y UNION ALL SELECT key, 3 + pid, 1.0::DOUBLE FROM ev UNION ALL SELECT key, 43 + i * 39 + pid - 1, v FROM y)
SELECT key, CAST(slot AS INT) AS slot, value, CAST(199 AS INT) AS width FROM z WHERE value <> 0""")
def phone_design(spark, sf_dir):
    """Every filled slot of the design: four cues, the symbol, and the cues of the symbol."""
    d = mo.phone_design(cues(spark, sf_dir), "source", fr.CUES, interactions=True)
    v = vector_to_array(F.col("features"))
    flat = d.select("key", F.size(v).alias("width"), F.posexplode(v).alias("slot", "value"))
    return flat.select("key", "slot", (F.round("value", 8) + F.lit(0.0)).alias("value"), "width").where("value <> 0")


def _split(spark, sf_dir):
    d = cues(spark, sf_dir).where(LABELLED)
    return d.where("grp < 'g08'"), d.where("grp >= 'g08'")


def newton_sql(rows: str, k: int, penalty: list[float], steps: int = 15) -> str:
    """Recursive CTE ``it(step, be0, ...)``: Newton steps of a logistic model over ``rows`` (x0, ..., y, w), elimination without pivots."""
    b = ", ".join(f"be{i}" for i in range(k))
    t = " + ".join(f"be{i} * x{i}" for i in range(k))
    sums = ", ".join([f"sum(w * (p - y) * x{i}) + {penalty[i]!r}::DOUBLE * be{i} AS g{i}" for i in range(k)] +
                     [f"sum(w * p * (1 - p) * x{i} * x{j})" + (f" + {penalty[i]!r}::DOUBLE" if i == j else "") + f" AS h{i}_{j}" for i in range(k) for j in range(i, k)])
    q = f"SELECT step, {b}, {sums} FROM (SELECT it.*, r.*, 1 / (1 + exp(-({t}))) AS p FROM it, {rows} r WHERE step < {steps}) GROUP BY step, {b}"
    h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    for c in range(k - 1):  # eliminate column c from the rows below
        new = [f"g{i} - {h(c, i)} / {h(c, c)} * g{c} AS g{i}" for i in range(c + 1, k)] + [f"{h(i, j)} - {h(c, i)} / {h(c, c)} * {h(c, j)} AS {h(i, j)}" for i in range(c + 1, k) for j in range(i, k)]
        old = [f"g{i}" for i in range(c + 1)] + [h(i, j) for i in range(c + 1) for j in range(i, k)]
        q = f"SELECT step, {b}, {', '.join(old + new)} FROM ({q})"
    for c in reversed(range(k)):  # solve from the last row up
        rest = "".join(f" - {h(c, j)} * d{j}" for j in range(c + 1, k))
        q = f"SELECT *, (g{c}{rest}) / {h(c, c)} AS d{c} FROM ({q})"
    start = ", ".join("0.0::DOUBLE" for _ in range(k))
    return f"it(step, {b}) AS (SELECT 0, {start} UNION ALL SELECT step + 1, {', '.join(f'be{i} - d{i}' for i in range(k))} FROM ({q})), fit AS (SELECT * FROM it WHERE step = {steps})"


CUES_SQL = f"""{PTOK_SQL}, {EVIDENCE_SQL.split("pa AS")[0].rstrip().rstrip(",")},
cu AS (SELECT *, {", ".join(f"sign({v}) * ln(1 + abs({v})) AS x{i + 1}" for i, v in enumerate(("-gop", "-viterbi_gop", "ln(sub / ok)", "ln(del / ok)")))} FROM ev WHERE {LABELLED})"""


def _held_out(spark, sf_dir, candidate):
    """Scores of the groups from g08 on by one candidate fitted on the others."""
    data = cues(spark, sf_dir).where(LABELLED).withColumn("g", F.substring("grp", 2, 2).cast("int"))
    rows = stored(data.select(F.lit(0).alias("ctx"), "g", fr.symbol_code(F.col("source")).alias("s"), F.col("gold_error").cast("int").alias("y"), *fr.CUES, "key", "grp"), "fit-rows")
    linear, trees = fr.fit_all(rows, [("fit|one", 0, frozenset(range(8, 12)))], [candidate], 12)
    test = rows.where("g >= 8").withColumn("name", F.lit("fit|one"))
    out = fr.scored_by(test, linear, trees).join(test.select("key", "grp", F.col("y").alias("gold_error")), "key")
    return out.select("key", "grp", "gold_error", F.round("score", 6).alias("score"))


@query("logistic_fit")
def logistic_fit(spark, sf_dir):
    return _held_out(spark, sf_dir, {"family": "logistic", "C": 1.0})


@query("boosted_fit")
def boosted_fit(spark, sf_dir):
    return _held_out(spark, sf_dir, {"family": "histogram", "iterations": 60, "leaves": 8})


PLATT_SQL = f"""WITH RECURSIVE {SCORED_SQL},
v AS (SELECT method, score, gold_error, grp, unnest(['ridge', 'weighted', 'standardized']) AS variant FROM scored),
gw AS (SELECT method, grp, sum(count(*)) OVER m / count(*) OVER m / count(*)::DOUBLE AS w FROM scored GROUP BY method, grp WINDOW m AS (PARTITION BY method)),
st AS (SELECT method, avg(score) m, stddev_pop(score) s, count(*) c FROM scored GROUP BY method),
cell AS (SELECT v.method, variant, (score - m) / s AS z, sum(CASE WHEN variant = 'ridge' THEN 1 ELSE w END) n, sum(CASE WHEN variant = 'ridge' THEN 1 ELSE w END * gold_error) pos,
  any_value(CASE variant WHEN 'ridge' THEN 2e-4::DOUBLE * c / s ** 2 WHEN 'weighted' THEN 1 / s ** 2 ELSE 1 END) pen FROM v JOIN gw USING (method, grp) JOIN st USING (method) GROUP BY ALL),
it(step, method, variant, a, b) AS (
  SELECT 0, method, variant, ln((sum(pos) / sum(n)) / (1 - sum(pos) / sum(n))), 0.0::DOUBLE FROM cell GROUP BY method, variant
  UNION ALL SELECT step + 1, method, variant, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT step, method, variant, a, b, sum(n * p - pos) ga, sum((n * p - pos) * z) + max(pen) * b gb, sum(n * p * (1 - p)) haa, sum(n * p * (1 - p) * z) hab, sum(n * p * (1 - p) * z * z) + max(pen) hbb
    FROM (SELECT it.*, z, n, pos, pen, 1 / (1 + exp(-(a + b * z))) p FROM it JOIN cell USING (method, variant) WHERE step < 25) GROUP BY step, method, variant, a, b)),
o AS (SELECT * FROM it JOIN st USING (method) WHERE step = 25)
SELECT method, variant, round(CASE WHEN variant = 'ridge' AND b < 0 THEN 0 ELSE b / s END, 8) + 0.0 AS slope,
  round(CASE WHEN variant = 'ridge' AND b < 0 THEN (SELECT a FROM it i WHERE i.step = 0 AND i.method = o.method AND i.variant = o.variant) ELSE a - b * m / s END, 8) + 0.0 AS intercept FROM o"""


@query("platt_fit", PLATT_SQL)
def platt_fit(spark, sf_dir):
    """All three calibration variants per scoring method."""
    out = ca.platt_many(scored(spark, sf_dir).select("method", "grp", "score", "gold_error"), ["method"], "score", "gold_error", ca.VARIANTS, "grp")
    return out.select("method", "variant", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("slope", "intercept")])


@query("apply_calibration", f"""WITH {SCORED_SQL}, c AS (SELECT method, key, cand_event, cand_conf, cand_margin, 1 / (1 + exp(-(0.05::DOUBLE * score - 3))) AS q FROM scored),
d AS (SELECT *, q >= 0.45 AS pr, q >= 0.45 AND cand_event IN ('substitution', 'deletion') AND cand_conf >= 0.6 AND cand_margin >= 0.1 AS au FROM c)
SELECT method, key, round(q, 8) p_error, pr AS predicted, au AS authorized, CASE WHEN au THEN cand_event WHEN pr THEN 'suspected_error' ELSE 'acceptable' END status FROM d""")
def apply_calibration(spark, sf_dir):
    out = mo.apply_calibration(scored(spark, sf_dir).drop("p_error", "predicted", "authorized"), "score", 0.05, -3.0, 0.45, gate=0.6)
    return rounded(out.select("method", "key", "p_error", "predicted", "authorized", "status"), "p_error")


ZS = ", ".join(f"(x{i} - me{i}) / sd{i} AS x{i}" for i in range(1, 5))
EVENT_TYPE_SQL = f"""WITH RECURSIVE {CUES_SQL},
er AS (SELECT * FROM cu WHERE grp < 'g08' AND stable_event AND gold_error = 1),
mo AS (SELECT {", ".join(f"avg(x{i}) AS me{i}, stddev_pop(x{i}) AS sd{i}" for i in range(1, 5))} FROM er),
gw AS (SELECT grp, sum(count(*)) OVER () / count(*) OVER () / count(*)::DOUBLE AS w FROM er GROUP BY grp),
tr AS (SELECT 1.0::DOUBLE AS x0, {ZS}, CAST(gold_event = 'substitution' AS INT) AS y, w FROM er JOIN gw USING (grp), mo),
{newton_sql("tr", 5, [0.0] + [10.0] * 4)},
te AS (SELECT key, nm[s1] AS n1, sub, {ZS}, 0.6::DOUBLE AS top FROM cu, mo WHERE grp >= 'g08')
SELECT key, round(1 / (1 + exp(-(be0 + be1 * x1 + be2 * x2 + be3 * x3 + be4 * x4))), 6) AS p_sub, n1 AS best_phone, round(top, 6) AS conditional FROM te, fit"""


@query("event_type_model", EVENT_TYPE_SQL)
def event_type_model(spark, sf_dir):
    """Substitution probability, and the phone with the largest conditional mass."""
    train, test = _split(spark, sf_dir)
    out = mo.event_type_fit(train, fr.CUES, "grp")[0](test)
    best = F.array_position("sub_parts", F.array_max("sub_parts")).cast("int")
    mass = F.array_max("sub_parts") / F.col("sub")
    names = F.array(*[F.lit(p) for p in PHONES])
    return out.select("key", F.round("p_sub", 6).alias("p_sub"), F.element_at(names, best).alias("best_phone"), F.round(mass, 6).alias("conditional"))


@query("gmm_density")
def gmm_density(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    symbols = [r[0] for r in f.select("label").distinct().orderBy("label").collect()]
    out = mo.gmm_density(f, f, "label", "vec", "vec_id", symbols)
    return out.select("vec_id", "label", F.round("density", 6).alias("density"))


@query("ensemble_mix", f"""WITH {SCORED_SQL}, w AS (SELECT key, max(p_error) FILTER (WHERE method = 'alpha') a, max(p_error) FILTER (WHERE method = 'beta') b, max(p_error) FILTER (WHERE method = 'gamma') c FROM scored GROUP BY key)
SELECT key, round(ln(p / (1 - p)), 8) + 0.0 AS score FROM (SELECT key, 0.5 * (a + b) / 2 + 0.5 * c AS p FROM w)""")
def ensemble_mix(spark, sf_dir):
    s = scored(spark, sf_dir)
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("p_error"))).alias(m)
    w = s.groupBy("key").agg(pick("alpha"), pick("beta"), pick("gamma"))
    mix = mo.ensemble_mix([[F.col("alpha"), F.col("beta")], [F.col("gamma")]])
    return w.select("key", (F.round(mix, 8) + F.lit(0.0)).alias("score"))


RES_CURVE = CURVE.replace("FROM scored", "FROM res_scored")


@query("residual_mix", f"""WITH {TOKENS_SQL}, b AS (SELECT grp, gold_error, ((key * 37 + k * 11) % 97 + gold_error * 30) / 10.0::DOUBLE g, ((key * 53 + k * 7) % 97 + gold_error * 18) / 10.0::DOUBLE i, (k % 10) / 5.0::DOUBLE d FROM tokens),
res_scored AS (SELECT w1 || '|' || w2 AS method, grp, gold_error, g + w1 * d + w2 * (i - g) AS score FROM b, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) x(w1), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) y(w2)),
{RES_CURVE}, m AS (SELECT CAST(split_part(method, '|', 1) AS DOUBLE) w1, CAST(split_part(method, '|', 2) AS DOUBLE) w2, avg(ap) ap FROM rank_metrics GROUP BY method)
SELECT w1, w2, round(ap, 8) macro_ap FROM m ORDER BY -round(ap, 12), w1 + w2, w1, w2 LIMIT 1""")
def residual_mix(spark, sf_dir):
    """Mixing weights by group-macro average precision; ties go to the lower total weight."""
    t = tokens(spark, sf_dir)
    t = t.select("grp", "gold_error", (((F.col("key") * 37 + F.col("k") * 11) % 97 + F.col("gold_error") * 30) / 10.0).alias("g"),
                 (((F.col("key") * 53 + F.col("k") * 7) % 97 + F.col("gold_error") * 18) / 10.0).alias("i"), (F.col("k") % 10 / 5.0).alias("d"))
    grid = mo.residual_grid(t, "g", "i", "d", "grp", "gold_error").withColumn("total", F.col("w1") + F.col("w2"))
    return rounded(se.grid_select(grid, [], "macro_ap", ["total", "w1", "w2"]).select("w1", "w2", "macro_ap"), "macro_ap")


PAIRWISE_SQL = f"""WITH RECURSIVE {CUES_SQL},
tn AS (SELECT * FROM cu WHERE grp < 'g08'),
ps AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key) r FROM tn WHERE gold_error = 1),
ns AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key) r FROM tn WHERE gold_error = 0),
sz AS (SELECT grp, count(*) FILTER (WHERE gold_error = 1) np, count(*) FILTER (WHERE gold_error = 0) nn FROM tn GROUP BY grp),
dr AS (SELECT *, least(512, np * nn) m, count(*) OVER () g FROM sz WHERE np > 0 AND nn > 0), du AS (SELECT *, unnest(generate_series(0, m - 1)) draw FROM dr),
ix AS (SELECT *, draw * (np * nn // m) + least(draw, np * nn % m) + ('0x' || substr(md5(grp || '-' || draw), 1, 15))::BIGINT % (np * nn // m + CAST(draw < np * nn % m AS BIGINT)) i FROM du),
gw AS (SELECT grp, 1.0::DOUBLE / count(*) OVER () / count(*) AS w FROM tn GROUP BY grp),
rw AS (SELECT x1 AS x0, x2 AS x1, x3 AS x2, x4 AS x3, 1.0::DOUBLE AS x4, gold_error AS y, w FROM tn JOIN gw USING (grp)
 UNION ALL SELECT a.x1 - b.x1, a.x2 - b.x2, a.x3 - b.x3, a.x4 - b.x4, 0, 1, 0.5::DOUBLE / g / m FROM ix JOIN ps a ON a.grp = ix.grp AND a.r = ix.i // nn + 1 JOIN ns b ON b.grp = ix.grp AND b.r = ix.i % nn + 1),
{newton_sql("rw", 5, [0.01] * 4 + [0.0])}
SELECT key, grp, gold_error, round(be0 * x1 + be1 * x2 + be2 * x3 + be3 * x4 + be4, 5) + 0.0 AS score FROM cu, fit WHERE grp >= 'g08'"""


@query("pairwise_rank_fit", PAIRWISE_SQL)
def pairwise_rank_fit(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    pairs = lk.pair_sample(train.select("grp", "key", "gold_error"), "grp", "key", "gold_error")
    coef, intercept = mo.pairwise_rank_fit(train.select("key", "grp", "gold_error", *fr.CUES), pairs, fr.CUES, "grp", "gold_error", 0.01)
    return test.select("key", "grp", "gold_error", (F.round(mo.linear_score(coef, intercept, fr.CUES), 5) + F.lit(0.0)).alias("score"))


def _folds(data):
    return fr.cyclic([tuple(r) for r in data.select("cohort", "grp").distinct().collect()])


@query("oof_predictions")
def oof_predictions(spark, sf_dir):
    """Out-of-fold scores of the inner candidates over all groups, each row under the chosen candidate."""
    data = cues(spark, sf_dir).where(LABELLED)
    groups = [r[0] for r in data.select("grp").distinct().collect()]
    out, chosen = fr.oof_scores(data, conf(spark, sf_dir), groups)
    return out.where(F.col("candidate") == chosen["candidate"]).withColumn("score", F.round("score", 5))


@query("fold_pipeline")
def fold_pipeline(spark, sf_dir):
    """Every group of both cohorts is tested once, under every strategy."""
    data = cues(spark, sf_dir)
    out, _ = fr.run_folds(data, conf(spark, sf_dir), _folds(data))
    return out.withColumns({"score": F.round("score", 5), "p_error": F.round("p_error", 5)})


@query("fold_run")
def fold_run(spark, sf_dir):
    """What every fold and strategy chose among all candidates, with its calibration."""
    data = cues(spark, sf_dir)
    _, chosen = fr.run_folds(data, conf(spark, sf_dir), _folds(data))
    return chosen.select("cohort", "fold", "strategy", "candidate", "threshold", *[F.round(c, 5).alias(c) for c in ("dev_ap", "slope", "intercept", "f1")])


@query("freeze_then_evaluate")
def freeze_then_evaluate(spark, sf_dir):
    """Predictions of all folds and strategies are frozen first; only then gold joins and metrics are computed."""
    path = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    data = cues(spark, sf_dir)
    out, _ = fr.run_folds(data, conf(spark, sf_dir), _folds(data))
    fr.freeze(out, path, out.columns, fr.PARTS)
    frozen = fr.load_frozen(spark, path, out.columns, fr.PARTS)
    # Gold comes from the label table, not from the frozen predictions.
    gold = lk.join_gold(frozen.withColumnRenamed("cohort", "part"), evidence(spark, sf_dir).where(LABELLED), ["event", "idx"])
    return det.token_metrics(gold, ["strategy", "part", "fold"], label="gold_error").select(
        "strategy", F.col("part").alias("cohort"), "fold", "n", "n_error", *[F.round(c, 5).alias(c) for c in ("ap", "auroc", "brier", "f1")])
