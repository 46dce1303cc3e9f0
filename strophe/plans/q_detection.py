"""Registered queries: detection and diagnosis metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import detection as det
from strophe.operators import diagnosis as dia
from strophe.plans.registry import query, rounded
from strophe.plans.tables import SCORED_ALL_SQL, SCORED_SQL, TOKENS_SQL, scored, tokens

G = ["method", "grp"]


def _scored(body: str) -> str:
    return f"WITH {SCORED_SQL}, {body}"


CURVE = """
cells AS (SELECT method, grp, score, count(*) n, count(*) FILTER (WHERE gold_error = 1) pos,
   count(*) FILTER (WHERE gold_error = 0) neg FROM scored GROUP BY ALL),
curve AS (SELECT *, sum(n) OVER w cn, sum(pos) OVER w cp, sum(neg) OVER w cneg,
   sum(pos) OVER g tp, sum(neg) OVER g tneg, sum(n) OVER g tn,
   lead(pos) OVER w1 npos, lead(neg) OVER w1 nneg, row_number() OVER w1 rn
   FROM cells WINDOW w AS (PARTITION BY method, grp ORDER BY score DESC),
   w1 AS (PARTITION BY method, grp ORDER BY score DESC), g AS (PARTITION BY method, grp)),
rank_metrics AS (SELECT method, grp, CAST(sum(n) AS BIGINT) n, CAST(sum(pos) AS BIGINT) n_error,
   sum(pos) / sum(n)::DOUBLE prevalence,
   CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos::DOUBLE / tp * cp / cn) END ap,
   CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) END auroc,
   CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN min(cneg::DOUBLE / tneg) FILTER (WHERE cp::DOUBLE / tp >= 0.8
     AND (rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg)) END fpr_at_recall
   FROM curve GROUP BY method, grp)"""

POINTS = """
clip AS (SELECT *, greatest(least(p_error, 1 - 1e-12), 1e-12) AS pc FROM scored),
points AS (SELECT method, grp, avg((pc - gold_error) * (pc - gold_error)) brier,
   avg(-CASE WHEN gold_error = 1 THEN ln(pc) ELSE ln(1 - pc) END) nll,
   count(*) FILTER (WHERE predicted AND gold_error = 1) tp, count(*) FILTER (WHERE predicted AND gold_error = 0) fp,
   count(*) FILTER (WHERE NOT predicted AND gold_error = 1) fn,
   count(*) FILTER (WHERE NOT predicted AND gold_error = 0) tn FROM clip GROUP BY method, grp),
rates AS (SELECT method, grp, brier, nll,
   coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) f1, fp::DOUBLE / nullif(fp + tn, 0) fpr,
   fn::DOUBLE / nullif(fn + tp, 0) fnr FROM points)"""


@query("average_precision", _scored(CURVE + """
SELECT method, grp, n, n_error, round(prevalence, 8) prevalence, round(ap, 8) ap FROM rank_metrics"""))
def average_precision(spark, sf_dir):
    out = det.ranking_metrics(scored(spark, sf_dir), G, "score", "gold_error")
    return rounded(out.select(*G, "n", "n_error", "prevalence", "ap"), "prevalence", "ap")


@query("auroc", _scored(CURVE + "SELECT method, grp, round(auroc, 8) auroc FROM rank_metrics"))
def auroc(spark, sf_dir):
    out = det.ranking_metrics(scored(spark, sf_dir), G, "score", "gold_error")
    return rounded(out.select(*G, "auroc"), "auroc")


@query("fpr_at_recall", _scored(CURVE + "SELECT method, grp, round(fpr_at_recall, 8) fpr_at_recall FROM rank_metrics"))
def fpr_at_recall(spark, sf_dir):
    out = det.ranking_metrics(scored(spark, sf_dir), G, "score", "gold_error")
    return rounded(out.select(*G, "fpr_at_recall"), "fpr_at_recall")


@query("brier_nll", _scored("""
c AS (SELECT *, greatest(least(p_error, 1 - 1e-15), 1e-15) AS pc FROM scored)
SELECT method, grp, round(avg((p_error - gold_error) * (p_error - gold_error)), 8) brier,
   round(avg(-CASE WHEN gold_error = 1 THEN ln(pc) ELSE ln(1 - pc) END), 8) nll FROM c GROUP BY ALL"""))
def brier_nll(spark, sf_dir):
    return rounded(det.probability_metrics(scored(spark, sf_dir), G, "p_error", "gold_error"), "brier", "nll")


@query("threshold_rates", _scored("""
s AS (SELECT *, score - 60 > 0 AS nat FROM scored),
c AS (SELECT method, grp, count(*) FILTER (WHERE predicted AND gold_error = 1) tp,
  count(*) FILTER (WHERE predicted AND gold_error = 0) fp, count(*) FILTER (WHERE NOT predicted AND gold_error = 1) fn,
  count(*) FILTER (WHERE NOT predicted AND gold_error = 0) tn, count(*) FILTER (WHERE nat AND gold_error = 1) a,
  count(*) FILTER (WHERE nat AND gold_error = 0) b, count(*) FILTER (WHERE NOT nat AND gold_error = 1) d
  FROM s GROUP BY ALL)
SELECT method, grp, round(coalesce(2.0::DOUBLE * tp / nullif(2*tp + fp + fn, 0), 0), 8) f1,
  round(fp::DOUBLE / nullif(fp + tn, 0), 8) fpr, round(fn::DOUBLE / nullif(fn + tp, 0), 8) fnr,
  round(coalesce(a::DOUBLE / nullif(a + b, 0), 0), 8) natural_precision,
  round(coalesce(a::DOUBLE / nullif(a + d, 0), 0), 8) natural_recall,
  round(coalesce(2.0::DOUBLE * a / nullif(2*a + b + d, 0), 0), 8) natural_f1 FROM c"""))
def threshold_rates(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("centred", F.col("score") - 60)
    out = det.decision_rates(df, G, "gold_error", "predicted", "centred")
    return rounded(out, "f1", "fpr", "fnr", "natural_precision", "natural_recall", "natural_f1")


@query("risk_coverage", _scored("""
r AS (SELECT method, grp, key, abs(p_error - 0.5) conf, CAST((p_error >= 0.5) <> (gold_error = 1) AS INT) bad FROM scored),
c AS (SELECT method, grp, sum(bad) OVER w AS cum, row_number() OVER w AS rn FROM r
   WINDOW w AS (PARTITION BY method, grp ORDER BY conf DESC, key ROWS UNBOUNDED PRECEDING))
SELECT method, grp, count(*) n, round(avg(cum::DOUBLE / rn), 8) aurc FROM c GROUP BY ALL"""))
def risk_coverage(spark, sf_dir):
    return rounded(det.risk_coverage(scored(spark, sf_dir), G, "p_error", "gold_error", "key"), "aurc")


@query("tie_aware_risk", _scored("""
r AS (SELECT method, grp, CASE WHEN predicted THEN p_error ELSE 1 - p_error END conf,
   CAST(predicted <> (gold_error = 1) AS INT) bad, key FROM scored),
t AS (SELECT method, grp, conf, key, avg(bad) OVER (PARTITION BY method, grp, conf) q,
   row_number() OVER (PARTITION BY method, grp ORDER BY conf DESC, key) rn,
   count(*) OVER (PARTITION BY method, grp) n, count(*) OVER (PARTITION BY method, grp, conf) m,
   row_number() OVER (PARTITION BY method, grp, conf ORDER BY key) tr FROM r),
u AS (SELECT *, sum(q) OVER (PARTITION BY method, grp ORDER BY rn ROWS UNBOUNDED PRECEDING) / rn risk FROM t)
SELECT method, grp, count(*) n, count(*) FILTER (WHERE m > 1 AND tr = 1) tie_groups,
   round((sum(risk) - max(risk) FILTER (WHERE rn = n) / 2) / count(*), 8) aurc,
   round(max(risk) FILTER (WHERE rn = greatest(1, floor(n * 0.1::DOUBLE))), 8) risk_010,
   round(max(risk) FILTER (WHERE rn = greatest(1, floor(n * 0.25::DOUBLE))), 8) risk_025,
   round(max(risk) FILTER (WHERE rn = greatest(1, floor(n * 0.5::DOUBLE))), 8) risk_050,
   round(max(risk) FILTER (WHERE rn = greatest(1, floor(n * 0.75::DOUBLE))), 8) risk_075,
   round(max(risk) FILTER (WHERE rn = n), 8) risk_100 FROM u GROUP BY method, grp"""))
def tie_aware_risk(spark, sf_dir):
    out = det.tie_aware_risk(scored(spark, sf_dir), G, "p_error", "predicted", "gold_error")
    return rounded(out, "aurc", "risk_010", "risk_025", "risk_050", "risk_075", "risk_100")


@query("precision_at_coverage", _scored("""
r AS (SELECT method, grp, CAST((p_error >= 0.5) = (gold_error = 1) AS INT) ok,
  row_number() OVER (PARTITION BY method, grp ORDER BY abs(p_error - 0.5) DESC, key) rn,
  count(*) OVER (PARTITION BY method, grp) n FROM scored)
SELECT method, grp, coverage, count(*) n_selected, round(avg(ok), 8) "precision" FROM r,
  (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(coverage)
WHERE rn <= greatest(1, ceil(coverage * n)) GROUP BY ALL"""))
def precision_at_coverage(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({
        "confidence": F.abs(F.col("p_error") - 0.5),
        "right": (F.col("p_error") >= 0.5).cast("int") == F.col("gold_error"),
    })
    return rounded(det.precision_at_coverage(df, G, "confidence", "right", "key"), "precision")


@query("matched_fpr", _scored("""
f AS (SELECT *, coalesce(cand_event = gold_event AND (gold_event = 'deletion' OR cand_symbol = realized), FALSE) same FROM scored),
k AS (SELECT f.*, kinds.kind, (kind = 'combined' AND gold_event <> 'match' OR kind = gold_event) AND stable_event is_gold,
   (kind = 'combined' AND cand_event IN ('substitution', 'deletion') OR kind = cand_event) AND stable_event is_prop
   FROM f, (VALUES ('substitution'), ('deletion'), ('combined')) kinds(kind)),
cells AS (SELECT method, grp, kind, score, count(*) n, count(*) FILTER (WHERE gold_error = 0) neg,
   count(*) FILTER (WHERE is_gold) g, count(*) FILTER (WHERE is_prop) p,
   count(*) FILTER (WHERE same AND is_gold) ok FROM k GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER w cneg, sum(p) OVER w cprop, sum(ok) OVER w cok, sum(neg) OVER a tneg, sum(g) OVER a tg
   FROM cells WINDOW w AS (PARTITION BY method, grp, kind ORDER BY score DESC), a AS (PARTITION BY method, grp, kind)),
edge AS (SELECT *, row_number() OVER (PARTITION BY method, grp, kind, t ORDER BY score DESC) rn
   FROM cum, (VALUES (0.01::DOUBLE), (0.05), (0.1)) x(t) WHERE neg > 0 AND cneg >= t * tneg),
e AS (SELECT *, (t * tneg - (cneg - neg)) / neg AS share FROM edge WHERE rn = 1),
v AS (SELECT method, grp, t AS target_fpr, kind, (cneg - neg + share * neg) / tneg achieved_fpr, CAST(tg AS BIGINT) gold,
   cprop - p + share * p proposals, cok - ok + share * ok true_positives FROM e),
w AS (SELECT *, coalesce(true_positives / nullif(proposals, 0), 0) "precision", coalesce(true_positives / nullif(gold, 0), 0) recall FROM v)
SELECT method, grp, target_fpr, kind, round(achieved_fpr, 8) achieved_fpr, gold, round(proposals, 8) proposals,
   round(true_positives, 8) true_positives, round("precision", 8) "precision", round(recall, 8) recall,
   round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 8) f1 FROM w"""))
def matched_fpr(spark, sf_dir):
    out = det.matched_fpr_diagnosis(scored(spark, sf_dir), G, "score", "gold_error")
    return rounded(out, "achieved_fpr", "proposals", "true_positives", "precision", "recall", "f1")


MACRO = CURVE + "," + POINTS + """,
both_ AS (SELECT * FROM rank_metrics JOIN rates USING (method, grp))"""


@query("macro_average", _scored(MACRO + """
SELECT method, round(avg(ap), 8) ap_macro, count(ap) ap_groups,
  round(CASE WHEN count(ap) = count(*) THEN avg(ap) END, 8) ap_strict, round(avg(nll), 8) nll_macro, count(nll) nll_groups,
  round(CASE WHEN count(nll) = count(*) THEN avg(nll) END, 8) nll_strict FROM both_ GROUP BY ALL"""))
def macro_average(spark, sf_dir):
    per = det.token_metrics(scored(spark, sf_dir), G, label="gold_error")
    out = det.macro_average(per, ["method"], ["ap", "nll"])
    return rounded(out, "ap_macro", "ap_strict", "nll_macro", "nll_strict")


@query("metrics_wide_long", _scored(MACRO + """
SELECT method, grp, metric, round(value, 8) AS value FROM (SELECT method, grp, ap, auroc, brier, f1, fpr FROM both_)
UNPIVOT INCLUDE NULLS (value FOR metric IN (ap, auroc, brier, f1, fpr))"""))
def metrics_wide_long(spark, sf_dir):
    per = det.token_metrics(scored(spark, sf_dir), G, label="gold_error")
    return rounded(per.unpivot(G, ["ap", "auroc", "brier", "f1", "fpr"], "metric", "value"), "value")


REPORT_COLS = "ap, auroc, fpr_at_recall, brier, nll, f1, fpr, fnr"
POOLED = MACRO.replace("method, grp", "method").replace("(method, grp)", "(method)")


@query("evaluation_report", f"""WITH {SCORED_SQL},
{MACRO},
long_ AS (SELECT method, grp, metric, value FROM (SELECT method, grp, {REPORT_COLS} FROM both_)
   UNPIVOT INCLUDE NULLS (value FOR metric IN ({REPORT_COLS}))),
pooled AS (WITH p0 AS (SELECT * EXCLUDE (grp), 'all' AS grp FROM scored), {MACRO.replace('FROM scored', 'FROM p0')}
   SELECT method, metric, value FROM (SELECT method, {REPORT_COLS} FROM both_)
   UNPIVOT INCLUDE NULLS (value FOR metric IN ({REPORT_COLS})))
SELECT method, 'group' AS scope, grp AS member, metric, round(value, 8) AS value FROM long_
UNION ALL SELECT method, 'macro', 'all', metric, round(avg(value), 8) FROM long_ GROUP BY method, metric
UNION ALL SELECT method, 'pooled', 'all', metric, round(value, 8) FROM pooled""")
def evaluation_report(spark, sf_dir):
    return rounded(dia.evaluation_report(scored(spark, sf_dir), ["method"], "grp", "gold_error"), "value")


@query("deletion_prf", _scored("""
c AS (SELECT method, grp, count(*) n, count(*) FILTER (WHERE gold_event = 'deletion') support,
 count(*) FILTER (WHERE p_error >= 0.5 AND cand_event = 'deletion') n_predicted,
 count(*) FILTER (WHERE p_error >= 0.5 AND cand_event = 'deletion' AND gold_event = 'deletion') tp
 FROM scored WHERE stable_event GROUP BY ALL),
d AS (SELECT *, tp::DOUBLE / nullif(n_predicted, 0) "precision", tp::DOUBLE / nullif(support, 0) recall FROM c)
SELECT method, grp, n, support, n_predicted, tp, round("precision", 8) "precision", round(recall, 8) recall,
 round(2 * "precision" * recall / nullif("precision" + recall, 0), 8) f1 FROM d"""))
def deletion_prf(spark, sf_dir):
    return rounded(dia.deletion_prf(scored(spark, sf_dir), G), "precision", "recall", "f1")


@query("diagnosis_prf", _scored("""
f AS (SELECT *, coalesce(cand_event = gold_event AND (cand_event = 'deletion' OR cand_symbol = realized), FALSE) ok
  FROM scored WHERE stable_event),
c AS (SELECT method, grp, count(*) n_exact, count(*) FILTER (WHERE gold_event = 'substitution') sub_gold,
 count(*) FILTER (WHERE predicted AND cand_event = 'substitution') sub_predicted,
 count(*) FILTER (WHERE predicted AND cand_event = 'substitution' AND ok) sub_tp,
 count(*) FILTER (WHERE gold_event = 'deletion') del_gold, count(*) FILTER (WHERE predicted AND cand_event = 'deletion') del_predicted,
 count(*) FILTER (WHERE predicted AND cand_event = 'deletion' AND ok) del_tp,
 count(*) FILTER (WHERE authorized) n_specific, count(*) FILTER (WHERE authorized AND ok) nok FROM f GROUP BY ALL),
d AS (SELECT *, sub_tp::DOUBLE / greatest(sub_predicted, 1) sub_precision, sub_tp::DOUBLE / greatest(sub_gold, 1) sub_recall,
 del_tp::DOUBLE / greatest(del_predicted, 1) del_precision, del_tp::DOUBLE / greatest(del_gold, 1) del_recall FROM c)
SELECT method, grp, n_exact, sub_gold, sub_predicted, sub_tp, del_gold, del_predicted, del_tp, n_specific,
 round(sub_precision, 8) sub_precision, round(sub_recall, 8) sub_recall,
 round(2 * sub_precision * sub_recall / greatest(sub_precision + sub_recall, 1e-12), 8) sub_f1,
 round(del_precision, 8) del_precision, round(del_recall, 8) del_recall,
 round(2 * del_precision * del_recall / greatest(del_precision + del_recall, 1e-12), 8) del_f1,
 round(n_specific::DOUBLE / greatest(n_exact, 1), 8) specific_coverage, round(nok::DOUBLE / nullif(n_specific, 0), 8) specific_precision FROM d"""))
def diagnosis_prf(spark, sf_dir):
    return rounded(dia.diagnosis_prf(scored(spark, sf_dir), G), "sub_precision", "sub_recall", "sub_f1",
                   "del_precision", "del_recall", "del_f1", "specific_coverage", "specific_precision")


@query("specific_output", _scored("""
c AS (SELECT method, grp, count(*) FILTER (WHERE p_error >= 0.5) n_error_predictions,
 count(*) FILTER (WHERE p_error >= 0.5 AND authorized) n_authorized, count(*) FILTER (WHERE p_error >= 0.5 AND authorized
  AND cand_event = gold_event AND (cand_event = 'deletion' OR cand_symbol = realized)) n_correct FROM scored GROUP BY ALL)
SELECT *, round(coalesce(n_authorized::DOUBLE / nullif(n_error_predictions, 0), 0), 8) coverage,
 round(n_correct::DOUBLE / nullif(n_authorized, 0), 8) "precision" FROM c"""))
def specific_output(spark, sf_dir):
    return rounded(dia.specific_output(scored(spark, sf_dir), G), "coverage", "precision")


GAPS_SQL = TOKENS_SQL + """,
gaps AS (SELECT event, idx, grp, key % 5 <> 0 AS stable, diagnostic, CAST(floor(value) AS BIGINT) % 4 AS n_ins,
   [inv[(k % 5) + 1], inv[((k + 1) % 5) + 1], inv[((k + 2) % 5) + 1]][1:CAST(floor(value) AS BIGINT) % 4] AS inserted
   FROM tokens)"""


def gap_labels(spark, sf_dir):
    """Gap before every position: 0-3 inserted symbols, stability and diagnostic flags."""
    tok = tokens(spark, sf_dir)
    inv = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    picks = F.array(*[F.element_at(inv, ((F.col("k") + j) % 5 + 1).cast("int")) for j in range(3)])
    n = (F.floor("value") % 4).cast("int")
    return tok.select("event", "idx", "grp", (F.col("key") % 5 != 0).alias("stable"), "diagnostic",
                      n.cast("long").alias("n_ins"), F.slice(picks, 1, n).alias("inserted"))


@query("insertion_prf", f"""WITH {GAPS_SQL},
slots AS (SELECT event, idx, ordinal, (key * (ordinal + 3)) % 100 / 100.0::DOUBLE AS insertion_probability,
   inv[(k + ordinal) % 5 + 1] AS slot_symbol FROM tokens, (VALUES (0), (1)) o(ordinal)),
r AS (SELECT g.grp, s.*, g.inserted[ordinal + 1] AS gold_symbol FROM slots s JOIN gaps g USING (event, idx)
   WHERE stable AND diagnostic AND n_ins <= 2),
c AS (SELECT grp, count(*) n_slots, count(gold_symbol) gold_insertions, count(*) FILTER (WHERE insertion_probability >= 0.5) n_positive,
   count(*) FILTER (WHERE insertion_probability >= 0.5 AND gold_symbol = slot_symbol) n_correct,
   avg(CAST(insertion_probability >= 0.5 AS INT)) FILTER (WHERE ordinal = 1) cap_hit_rate FROM r GROUP BY grp),
d AS (SELECT *, n_correct::DOUBLE / greatest(n_positive, 1) "precision", n_correct::DOUBLE / greatest(gold_insertions, 1) recall FROM c)
SELECT grp, n_slots, gold_insertions, n_positive, n_correct, round(cap_hit_rate, 8) cap_hit_rate, round("precision", 8) "precision",
   round(recall, 8) recall, round(2 * "precision" * recall / greatest("precision" + recall, 1e-12), 8) f1 FROM d""")
def insertion_prf(spark, sf_dir):
    tok = tokens(spark, sf_dir)
    inv = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    slots = tok.select("event", "idx", "key", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).select(
        "event", "idx", "ordinal",
        ((F.col("key") * (F.col("ordinal") + 3)) % 100 / 100.0).alias("insertion_probability"),
        F.element_at(inv, ((F.col("k") + F.col("ordinal")) % 5 + 1).cast("int")).alias("slot_symbol"))
    gaps = gap_labels(spark, sf_dir).select("event", "idx", "grp", "stable", "diagnostic", "inserted")
    labelled = slots.join(gaps.select("event", "idx", "grp"), ["event", "idx"])
    out = dia.insertion_prf(labelled, gaps.drop("grp"), ["grp"], ["event", "idx"])
    return rounded(out, "cap_hit_rate", "precision", "recall", "f1")


@query("candidate_retention", _scored("""
a AS (SELECT *, [inv[(target_id % 5) + 1], inv[((target_id + 1) % 5) + 1]] AS allowed, [target] AS accepted FROM scored
   WHERE stable_event AND gold_event = 'substitution'),
b AS (SELECT *, list_contains(list_concat(allowed, accepted), realized) kept FROM a),
c AS (SELECT method, grp, count(*) n_substitutions, count(*) FILTER (WHERE kept) retained, count(*) FILTER (WHERE NOT kept) missing,
   count(*) FILTER (WHERE NOT kept AND predicted <> (gold_error = 1)) missing_errors,
   count(*) FILTER (WHERE NOT kept AND NOT predicted) fn FROM b GROUP BY ALL)
SELECT * EXCLUDE (fn), round(retained::DOUBLE / nullif(n_substitutions, 0), 8) retention_rate,
   round(missing_errors::DOUBLE / nullif(missing, 0), 8) missing_error_rate, round(fn::DOUBLE / nullif(missing, 0), 8) missing_fnr FROM c"""))
def candidate_retention(spark, sf_dir):
    inv = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    pick = lambda j: F.element_at(inv, ((F.col("target_id") + j) % 5 + 1).cast("int"))
    df = scored(spark, sf_dir).withColumns({"allowed": F.array(pick(0), pick(1)), "accepted": F.array("target")})
    return rounded(dia.candidate_retention(df, G, "allowed", "accepted"),
                   "retention_rate", "missing_error_rate", "missing_fnr")


@query("strata_metrics", _scored("""
s0 AS (SELECT * FROM (SELECT method, gold_error, p_error AS score, unnest([
   {'f': 'target', 'v': target}, {'f': 'cohort', 'v': cohort}, {'f': 'note', 'v': CASE WHEN key % 3 = 0 THEN '' WHEN key % 3 = 1 THEN 'odd' END}]) u FROM scored)),
scored_s AS (SELECT method, u.f || '|' || u.v AS grp, gold_error, score FROM s0 WHERE u.v IS NOT NULL AND u.v <> ''),"""
 + CURVE.replace("FROM scored", "FROM scored_s") + """,
pm AS (SELECT method, grp, avg((score - gold_error) * (score - gold_error)) brier,
  avg(-CASE WHEN gold_error = 1 THEN ln(score) ELSE ln(1 - score) END) nll FROM scored_s GROUP BY ALL)
SELECT method, split_part(grp, '|', 1) field, split_part(grp, '|', 2) stratum, n, n_error, round(prevalence, 8) prevalence,
  round(ap, 8) ap, round(auroc, 8) auroc, round(brier, 8) brier, round(nll, 8) nll FROM rank_metrics JOIN pm USING (method, grp)"""))
def strata_metrics(spark, sf_dir):
    note = F.when(F.col("key") % 3 == 0, "").when(F.col("key") % 3 == 1, "odd")
    df = scored(spark, sf_dir).withColumn("note", note)
    out = dia.strata_metrics(df, ["method"], ["target", "cohort", "note"], "gold_error", "p_error").drop("fpr_at_recall")
    return rounded(out, "prevalence", "ap", "auroc", "brier", "nll")


@query("accepted_variant_alarms", f"""WITH {SCORED_ALL_SQL},
v AS (SELECT *, CASE WHEN gold_event = 'substitution' AND realized_id = target_id % 5 + 1 THEN 'match' ELSE gold_event END AS ev,
   [target, inv[target_id % 5 + 1]] AS accepted FROM (SELECT *, list_position(inv, realized) AS realized_id FROM scored_all
   WHERE quality IS NULL AND diagnostic AND stable_error))
SELECT method, count(*) n, count(*) FILTER (WHERE predicted) false_alarms, round(avg(CAST(predicted AS INT)), 8) rate FROM v
WHERE stable_event AND ev = 'match' AND realized <> target AND list_contains(accepted, realized) GROUP BY method""")
def accepted_variant_alarms(spark, sf_dir):
    inv = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    follower = F.element_at(inv, (F.col("target_id") % 5 + 1).cast("int"))
    variant = (F.col("gold_event") == "substitution") & (F.col("realized") == follower)
    df = scored(spark, sf_dir).withColumns({
        "accepted": F.array(F.col("target"), follower),
        "gold_event": F.when(variant, "match").otherwise(F.col("gold_event"))})
    return rounded(dia.accepted_variant_alarms(df, ["method"], "accepted"), "rate")


SUBTASK_CURVE = CURVE.replace("FROM scored", "FROM tagged")


@query("subtask_ranking", _scored("""
tagged0 AS (SELECT method, score, gold_error, unnest([CASE WHEN TRUE THEN 'all' END,
  CASE WHEN stable_event AND gold_event IN ('match','substitution') THEN 'match_sub' END,
  CASE WHEN stable_event AND gold_event IN ('match','deletion') THEN 'match_del' END,
  CASE WHEN gold_event = 'match' OR (NOT stable_event AND gold_error = 1) THEN 'match_ambiguous' END]) AS grp FROM scored),
tagged AS (SELECT * FROM tagged0 WHERE grp IS NOT NULL),""" + SUBTASK_CURVE + """
SELECT method, grp AS subtask, n, n_error, round(ap, 8) ap, round(auroc, 8) auroc FROM rank_metrics"""))
def subtask_ranking(spark, sf_dir):
    out = dia.subtask_ranking(scored(spark, sf_dir), ["method"], "score", "gold_error")
    return rounded(out.drop("prevalence", "fpr_at_recall"), "ap", "auroc")


@query("failure_decomposition", _scored("""
f AS (SELECT *, CASE WHEN stable_event THEN gold_event WHEN gold_error = 1 THEN 'ambiguous_error' ELSE 'ambiguous_correct' END composition,
  gold_event = 'substitution' AND stable_event AND coalesce(cand_event = gold_event AND cand_symbol = realized, FALSE) good FROM scored)
SELECT method, composition, count(*) n, count(*) FILTER (WHERE cand_event = 'substitution') cand_substitution,
  count(*) FILTER (WHERE cand_event = 'deletion') cand_deletion, count(*) FILTER (WHERE predicted) predicted_error,
  count(*) FILTER (WHERE good) correct_before_threshold, count(*) FILTER (WHERE good AND predicted) correct_after_threshold,
  count(*) FILTER (WHERE good AND authorized) correct_after_gate, round(avg(p_error), 8) mean_p_error FROM f GROUP BY ALL"""))
def failure_decomposition(spark, sf_dir):
    return rounded(dia.failure_decomposition(scored(spark, sf_dir), ["method"]), "mean_p_error")


@query("healthy_by_fold", _scored("""
h AS (SELECT method, 'fold' || CAST(event % 3 AS VARCHAR) fold, p_error, gold_error, predicted FROM scored WHERE cohort = 'control'),
f AS (SELECT method, fold, count(*) n, avg((p_error - gold_error) * (p_error - gold_error)) brier,
  avg(CAST(predicted AS INT)) FILTER (WHERE gold_error = 0) fpr FROM h GROUP BY ALL)
SELECT method, count(*) folds, round(avg(brier), 8) mean_brier, round(avg(fpr), 8) mean_fpr FROM f GROUP BY method"""))
def healthy_by_fold(spark, sf_dir):
    """The control cohort evaluated by every fold's scores, then the descriptive mean."""
    control = scored(spark, sf_dir).where("cohort = 'control'").withColumn(
        "fold", F.concat(F.lit("fold"), (F.col("event") % 3).cast("string")))
    keys = ["method", "fold"]
    per = det.probability_metrics(control, keys, "p_error", "gold_error").join(
        det.decision_rates(control, keys, "gold_error"), keys)
    out = per.groupBy("method").agg(F.count(F.lit(1)).alias("folds"), F.avg("brier").alias("mean_brier"),
                                    F.avg("fpr").alias("mean_fpr"))
    return rounded(out, "mean_brier", "mean_fpr")


@query("calibration_delta", _scored("""
b AS (SELECT method, grp, avg((raw - gold_error) * (raw - gold_error)) b0, avg((p_error - gold_error) * (p_error - gold_error)) b1,
   avg(-CASE WHEN gold_error = 1 THEN ln(raw) ELSE ln(1 - raw) END) n0,
   avg(-CASE WHEN gold_error = 1 THEN ln(p_error) ELSE ln(1 - p_error) END) n1
   FROM (SELECT *, (score + 1) / 200.0::DOUBLE AS raw FROM scored) GROUP BY ALL)
SELECT method, round(avg(b0), 8) brier_before, round(avg(b1), 8) brier_after, round(avg(n0), 8) nll_before, round(avg(n1), 8) nll_after
FROM b GROUP BY method"""))
def calibration_delta(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("raw", (F.col("score") + 1) / 200.0)
    before = det.probability_metrics(df, G, "raw", "gold_error", 1e-12).withColumnsRenamed({"brier": "b0", "nll": "n0"})
    after = det.probability_metrics(df, G, "p_error", "gold_error", 1e-12)
    out = before.join(after, G).groupBy("method").agg(
        F.avg("b0").alias("brier_before"), F.avg("brier").alias("brier_after"),
        F.avg("n0").alias("nll_before"), F.avg("nll").alias("nll_after"))
    return rounded(out, "brier_before", "brier_after", "nll_before", "nll_after")


@query("rank_metrics", f"""WITH {TOKENS_SQL},
c AS (SELECT t.key, grp, realized, s.c AS candidate, ((key * 31 + s.i * s.i * 17 + k) % 23 + 1) / 100.0::DOUBLE AS prob FROM tokens t,
   (VALUES ('click',1),('error',2),('purchase',3),('signup',4),('view',5)) s(c, i)
   WHERE stable_event AND gold_event = 'substitution' AND s.c <> target),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prob DESC, candidate) rk FROM c)
SELECT grp, count(*) n, round(avg(CAST(rk <= 1 AS INT)), 8) top1, round(avg(CAST(rk <= 3 AS INT)), 8) top3, round(avg(1.0::DOUBLE / rk), 8) mrr
FROM r WHERE candidate = realized GROUP BY grp""")
def rank_metrics(spark, sf_dir):
    tok = tokens(spark, sf_dir).where("stable_event AND gold_event = 'substitution'")
    syms = F.array(*[F.struct(F.lit(s).alias("candidate"), F.lit(i + 1).alias("i"))
                     for i, s in enumerate(("click", "error", "purchase", "signup", "view"))])
    c = tok.select("key", "grp", "k", "target", "realized", F.explode(syms).alias("s")).select("*", "s.*").where("candidate <> target")
    c = c.withColumn("prob", ((F.col("key") * 31 + F.col("i") * F.col("i") * 17 + F.col("k")) % 23 + 1) / 100.0)
    return rounded(dia.rank_metrics(c.drop("s"), ["grp"], ["key"]), "top1", "top3", "mrr")

