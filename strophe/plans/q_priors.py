"""Registered queries: confusion statistics and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import inventory as inv
from strophe.operators import audits as au
from strophe.operators import priors as pr
from strophe.plans.q_detection import GAPS_SQL, gap_labels
from strophe.plans.registry import query, rounded
from strophe.plans.tables import PTOK_SQL, SYMBOLS, phone_tokens
from strophe.session import stored


def conf(spark, sf_dir):
    """Confusion counts (groups times inventory squared rows at most), counted once however often a plan uses them."""
    return stored(au.confusion_counts(phone_tokens(spark, sf_dir), ["grp", "cohort"]), "confusion-counts")


RATES_SQL = PTOK_SQL + """,
expo AS (SELECT grp, sum(n) e FROM conf GROUP BY grp), ng AS (SELECT count(DISTINCT grp) + 2 AS g FROM ptok),
rates AS (SELECT source, alternative, CAST(sum(n) AS BIGINT) raw_count, count(DISTINCT grp) n_groups, sum(n / e) / max(g) AS rate
  FROM conf JOIN expo USING (grp), ng WHERE op = 'SUB' AND source <> alternative GROUP BY ALL)"""


def _rates(spark, sf_dir):
    """Two registered training groups have no rows at all and still count in the mean."""
    groups = phone_tokens(spark, sf_dir).select("grp").distinct()
    silent = spark.createDataFrame([("s1",), ("s2",)], "grp string")
    return pr.balanced_rates(conf(spark, sf_dir), groups.unionByName(silent))


@query("balanced_rates", f"WITH {RATES_SQL} SELECT source, alternative, raw_count, n_groups, round(rate, 10) rate FROM rates")
def balanced_rates(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("rate", F.round("rate", 10))


@query("topk_neighbors", f"""WITH {RATES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(rate, 15) DESC, raw_count DESC, list_position({'[' + ','.join(repr(p) for p in inv.PHONES) + ']'}, alternative)) "rank" FROM rates WHERE raw_count >= 2)
SELECT source, alternative, raw_count, "rank" FROM r WHERE "rank" <= 3""")
def topk_neighbors(spark, sf_dir):
    return pr.topk_neighbors(_rates(spark, sf_dir), k=3, min_count=2).select("source", "alternative", "raw_count", F.col("rank").cast("long").alias("rank"))


PRIOR_SQL = PTOK_SQL + """,
sz AS (SELECT grp, sum(n) ng, count(*) OVER () g FROM conf GROUP BY grp),
scl AS (SELECT conf.*, n * (1000.0::DOUBLE / ng / g) m FROM conf JOIN sz USING (grp)),
ps AS (SELECT source, sum(n) raw_count, count(DISTINCT grp) n_groups, sum(m) FILTER (WHERE op = 'OK') o, sum(m) FILTER (WHERE op = 'SUB') s,
   sum(m) FILTER (WHERE op = 'DEL') d FROM scl GROUP BY source),
ov AS (SELECT sum(o) + 18.0::DOUBLE go, sum(s) + 1.4::DOUBLE gs, sum(d) + 0.6::DOUBLE gd FROM ps),
pt AS (SELECT phone AS source, coalesce(raw_count, 0) raw_count, coalesce(n_groups, 0) n_groups, coalesce(raw_count, 0) < 20 OR coalesce(n_groups, 0) < 2 AS fallback,
   coalesce(o, 0) + 18.0::DOUBLE o, coalesce(s, 0) + 1.4::DOUBLE s, coalesce(d, 0) + 0.6::DOUBLE d, go, gs, gd FROM phones LEFT JOIN ps ON phone = source, ov),
ops AS (SELECT source, unnest(['OK', 'SUB', 'DEL']) op, CASE WHEN fallback THEN unnest([go, gs, gd]) / (go + gs + gd) ELSE unnest([o, s, d]) / (o + s + d) END p,
   CAST(raw_count AS BIGINT) raw_count, n_groups, fallback FROM pt),
sm AS (SELECT source, alternative AS target, sum(m) m FROM scl WHERE op = 'SUB' GROUP BY ALL),
gm AS (SELECT target, sum(m) gm FROM sm GROUP BY target),
sd AS (SELECT pt.source, phones.phone AS target, fallback, coalesce(CASE WHEN fallback THEN gm ELSE m END, 0) + 20.0::DOUBLE / 38 w
   FROM pt JOIN phones ON pt.source <> phones.phone LEFT JOIN sm ON sm.source = pt.source AND sm.target = phones.phone LEFT JOIN gm ON gm.target = phones.phone),
subs AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) p, fallback FROM sd)"""


@query("group_equal_prior", f"""WITH {PRIOR_SQL}
SELECT source, op AS edge, round(p, 10) p, fallback FROM ops UNION ALL SELECT source, 'SUB:' || target, round(p, 10), fallback FROM subs""")
def group_equal_prior(spark, sf_dir):
    ops, subs = pr.group_equal_prior(conf(spark, sf_dir))
    out = ops.select("source", F.col("op").alias("edge"), "p", "fallback").unionByName(
        subs.select("source", F.concat(F.lit("SUB:"), F.col("target")).alias("edge"), "p", "fallback"))
    return out.withColumn("p", F.round("p", 10))


@query("insertion_rate", f"""WITH {GAPS_SQL},
u AS (SELECT g.grp, n_ins, inserted FROM gaps g JOIN tokens t USING (event, idx) WHERE g.stable AND g.diagnostic AND t.quality IS NULL),
ng AS (SELECT count(DISTINCT grp) n FROM tokens),
p AS (SELECT grp, count(*) gaps, sum(least(n_ins, 2)) s, count(*) FILTER (WHERE n_ins < 2) f, count(*) FILTER (WHERE n_ins > 2) o FROM u GROUP BY grp),
q AS (SELECT CAST(sum(gaps) AS BIGINT) gaps, CAST(sum(o) AS BIGINT) over_cap, sum(s * 1000.0::DOUBLE / gaps / n) success, sum(f * 1000.0::DOUBLE / gaps / n) failure FROM p, ng),
h AS (SELECT grp, unnest(inserted[1:2]) symbol FROM u),
sy AS (SELECT symbol, sum(1000.0::DOUBLE / gaps / n) m FROM h JOIN p USING (grp), ng GROUP BY symbol),
dd AS (SELECT x AS symbol, coalesce(m, 0) + 4.0::DOUBLE w FROM (SELECT unnest(['click','error','purchase','signup','view']) x) LEFT JOIN sy ON symbol = x)
SELECT 'rate' AS item, gaps, over_cap, round((success + 0.4::DOUBLE) / (success + failure + 20), 8) p FROM q
UNION ALL SELECT symbol, NULL, NULL, round(w / sum(w) OVER (), 8) FROM dd""")
def insertion_rate(spark, sf_dir):
    g = gap_labels(spark, sf_dir).withColumn("quality", F.when(F.col("event") % 23 == 0, "review"))
    rate = pr.insertion_rate(g, "grp").select(F.lit("rate").alias("item"), "gaps", "over_cap", F.col("insertion_probability").alias("p"))
    sym = pr.insertion_symbols(g, "grp", SYMBOLS).select(
        F.col("symbol").alias("item"), F.lit(None).cast("long").alias("gaps"), F.lit(None).cast("long").alias("over_cap"), "p")
    return rounded(rate.unionByName(sym), "p")


def _phone_rows() -> str:
    rows = []
    for p in inv.PHONES:
        if p in inv.VOWEL_FEATURES:
            h, b, r = inv.VOWEL_FEATURES[p]
            rows.append(f"('{p}', TRUE, {h}, {b}, {r}, NULL, NULL, NULL, NULL)")
        else:
            pl, m, v = inv.CONSONANT_FEATURES[p]
            rows.append(f"('{p}', FALSE, NULL, NULL, NULL, '{pl}', {inv.PLACES.index(pl)}, '{m}', {v})")
    return ", ".join(rows)


FIXED_SQL = f"""ft AS (SELECT phone, v, h::DOUBLE h, b::DOUBLE b, r::DOUBLE r, place, pr, manner, voiced FROM (VALUES {_phone_rows()}) x(phone, v, h, b, r, place, pr, manner, voiced)),
fw AS (SELECT x.phone source, y.phone alternative, exp(-CASE WHEN x.v AND y.v THEN abs(x.h - y.h) + abs(x.b - y.b) + 0.7::DOUBLE * abs(x.r - y.r)
   WHEN NOT x.v AND NOT y.v THEN 1.5::DOUBLE * abs(x.pr - y.pr) / 7 + CASE WHEN x.manner = y.manner THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN x.voiced = y.voiced THEN 0 ELSE 0.4::DOUBLE END ELSE 2.5::DOUBLE END)
   * CASE WHEN x.v AND y.v THEN CASE WHEN y.phone = 'AH' THEN 2.0::DOUBLE ELSE 1.3::DOUBLE END WHEN x.v <> y.v THEN 0.7::DOUBLE ELSE
     CASE WHEN x.manner <> y.manner AND x.manner IN ('stop','fricative','affricate') AND y.manner IN ('stop','fricative','affricate') THEN 1.8::DOUBLE ELSE 1 END
     * CASE WHEN x.voiced <> y.voiced THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN x.place <> y.place AND x.place IN ('alveolar','velar') AND y.place IN ('alveolar','velar') THEN 1.6::DOUBLE ELSE 1 END
     * CASE WHEN x.manner = 'nasal' OR y.manner = 'nasal' THEN 1.3::DOUBLE ELSE 1 END END w
   FROM ft x, ft y WHERE x.phone <> y.phone UNION ALL SELECT phone, '<DEL>', CASE WHEN v THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END FROM ft),
fixed AS (SELECT source, alternative, w / sum(w) OVER (PARTITION BY source) p FROM fw)"""


@query("distance_prior", f"""WITH {PTOK_SQL}, {FIXED_SQL}
SELECT source, alternative, count(*) n, round(sum(p), 8) mass FROM ptok JOIN fixed ON source = target
 WHERE alternative = coalesce(realized, '<DEL>') AND gold_error = 1 GROUP BY ALL""")
def distance_prior(spark, sf_dir):
    """Prior mass of every observed error, summed per edge over all positions."""
    prior = F.broadcast(pr.distance_prior(spark))
    t = phone_tokens(spark, sf_dir).where("gold_error = 1").select(
        F.col("target").alias("source"), F.coalesce("realized", F.lit(inv.DELETE)).alias("alternative"))
    out = t.join(prior, ["source", "alternative"]).groupBy("source", "alternative").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass"))
    return rounded(out, "mass")


ENRICH_SQL = f"""{PTOK_SQL}, {FIXED_SQL},
et AS (SELECT cohort, grp, source, sum(n) FILTER (WHERE op <> 'OK') t FROM conf GROUP BY ALL),
eg AS (SELECT e.cohort, e.grp, f.source, f.alternative, (coalesce(c.n, 0) + 20 * f.p) / (coalesce(t, 0) + 20) q
  FROM et e JOIN fixed f USING (source) LEFT JOIN conf c ON c.grp = e.grp AND c.source = f.source AND c.alternative = f.alternative AND c.op <> 'OK'),
em AS (SELECT cohort, source, alternative, avg(q) q FROM eg GROUP BY ALL),
ew AS (SELECT source, alternative, p * greatest(least(coalesce(a.q, p) / coalesce(b.q, p), 4.0::DOUBLE), 0.25::DOUBLE) w FROM fixed
  LEFT JOIN (SELECT * FROM em WHERE cohort = 'case') a USING (source, alternative) LEFT JOIN (SELECT * FROM em WHERE cohort = 'control') b USING (source, alternative)),
enriched AS (SELECT source, alternative, w / sum(w) OVER (PARTITION BY source) p FROM ew)"""


def _enriched(spark, sf_dir):
    fixed = pr.distance_prior(spark)
    return fixed, pr.enrichment_prior(conf(spark, sf_dir), fixed, "grp", "cohort", "case", "control")


@query("enrichment_prior", f"WITH {ENRICH_SQL} SELECT source, alternative, round(p, 10) p FROM enriched")
def enrichment_prior(spark, sf_dir):
    return _enriched(spark, sf_dir)[1].withColumn("p", F.round("p", 10))


@query("mixed_prior", f"""WITH {ENRICH_SQL},
w AS (SELECT lam, source, alternative, 0.05::DOUBLE / 39 + 0.95::DOUBLE * ((1 - lam) * f.p + lam * e.p) w FROM fixed f JOIN enriched e USING (source, alternative), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) g(lam))
SELECT lam, source, alternative, round(w / sum(w) OVER (PARTITION BY lam, source), 10) p FROM w""")
def mixed_prior(spark, sf_dir):
    fixed, emp = _enriched(spark, sf_dir)
    return pr.mixed_prior(fixed, emp).withColumn("p", F.round("p", 10))


def _short_rows() -> str:
    return ", ".join(f"('{s}', '{a}')" for s, alts in inv.SHORT_LIST.items() for a in [*alts, inv.DELETE])


@query("prune_renormalize", f"""WITH {ENRICH_SQL}, sl AS (SELECT * FROM (VALUES {_short_rows()}) x(source, alternative))
SELECT source, alternative, round(p / sum(p) OVER (PARTITION BY source), 10) p FROM enriched JOIN sl USING (source, alternative)""")
def prune_renormalize(spark, sf_dir):
    emp = _enriched(spark, sf_dir)[1]
    return pr.prune_renormalize(emp, pr.short_list_table(spark)).withColumn("p", F.round("p", 10))


def _graph_sql() -> str:
    proj = {k: inv.PROJECTION.get(v, v) for k, v in {**inv.IPA_SYMBOLS, **inv.IPA_CONFUSION_ALIASES}.items()}
    edges = ", ".join(f"('{s}', '{t}')" for s, ts in inv.IPA_CONFUSIONS.items() for t in ts)
    maps = ", ".join(f"('{k}', '{v}')" for k, v in proj.items())
    return f"""ge AS (SELECT DISTINCT a.v s, b.v t FROM (VALUES {edges}) e(x, y) JOIN (VALUES {maps}) a(k, v) ON a.k = x JOIN (VALUES {maps}) b(k, v) ON b.k = y WHERE a.v <> b.v)"""


@query("directed_graph_build", f"""WITH {PTOK_SQL}, {_graph_sql()}
SELECT target AS source, realized AS alternative, count(*) n, bool_or(ge.s IS NOT NULL) AS on_graph FROM ptok LEFT JOIN ge ON s = target AND t = realized
 WHERE gold_event = 'substitution' GROUP BY ALL""")
def directed_graph_build(spark, sf_dir):
    """Observed substitutions against the projected directed graph."""
    g = pr.directed_graph(pr.confusion_edges(spark), pr.projection_table(spark)).where("status = 'kept'")
    g = F.broadcast(g.select(F.col("s").alias("source"), F.col("t").alias("alternative"), F.lit(True).alias("hit")))
    t = phone_tokens(spark, sf_dir).where("gold_event = 'substitution'").groupBy(
        F.col("target").alias("source"), F.col("realized").alias("alternative")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(g, ["source", "alternative"], "left").select("source", "alternative", "n", F.col("hit").isNotNull().alias("on_graph"))


RELIABILITY_SQL = """rel AS (SELECT phone AS source, coalesce(n, 0) n, coalesce(n_groups, 0) n_groups,
  coalesce(n, 0) / (coalesce(n, 0) + 10.0::DOUBLE) * least(1, coalesce(n_groups, 0) / 2.0::DOUBLE) reliability FROM phones LEFT JOIN
  (SELECT source, CAST(sum(n) AS BIGINT) n, count(DISTINCT grp) n_groups FROM conf WHERE op = 'SUB' GROUP BY source) ON phone = source)"""


@query("identity_reliability", f"WITH {PTOK_SQL}, {RELIABILITY_SQL} SELECT source, n, n_groups, round(reliability, 8) reliability FROM rel")
def identity_reliability(spark, sf_dir):
    return rounded(pr.identity_reliability(conf(spark, sf_dir), "grp"), "reliability")


@query("prior_edge_table", f"""WITH {PRIOR_SQL},
e AS (SELECT source, op, CASE op WHEN 'OK' THEN source ELSE '<DEL>' END alternative, p op_p, 1.0::DOUBLE cond_p, fallback FROM ops WHERE op <> 'SUB'
 UNION ALL SELECT ops.source, op, target, ops.p, subs.p, ops.fallback FROM ops JOIN subs USING (source) WHERE op = 'SUB'),
c AS (SELECT source, op, alternative, sum(n) n FROM conf GROUP BY ALL)
SELECT source, op, alternative, round(op_p, 10) op_p, round(cond_p, 10) cond_p, round(op_p * cond_p, 10) joint_p, CAST(coalesce(n, 0) AS BIGINT) raw_train_count, fallback
FROM e LEFT JOIN c USING (source, op, alternative)""")
def prior_edge_table(spark, sf_dir):
    c = conf(spark, sf_dir)
    out = pr.prior_edges(*pr.group_equal_prior(c), c)
    return out.withColumns({x: F.round(x, 10) for x in ("op_p", "cond_p", "joint_p")})


def evidence(spark, sf_dir):
    """Position posteriors: mass on the reference, on a deletion and on two other phones."""
    t = phone_tokens(spark, sf_dir).where("diagnostic")
    ok = 0.5 + (F.col("k") % 10) / 50.0
    t = t.withColumns({"ok": ok, "del": 0.05 + (F.col("key") % 5) / 100.0}).withColumn("sub", 1 - F.col("ok") - F.col("del"))
    s1, s2 = F.col("pid") % 39 + 1, (F.col("pid") + 6) % 39 + 1
    ids = F.sequence(F.lit(1), F.lit(39))
    t = t.withColumns({"s1": s1, "s2": s2})
    t = t.withColumns({
        "sub_parts": F.transform(ids, lambda i: F.when(i == F.col("s1"), 0.6 * F.col("sub")).when(i == F.col("s2"), 0.4 * F.col("sub")).otherwise(0.0)),
        "accepted": F.when(F.col("key") % 4 == 0, F.array(F.col("pid"), (F.col("pid") + 2) % 39 + 1)).otherwise(F.array("pid")),
        "gop": F.log(F.col("ok") / (1 - F.col("ok"))),
        "b1": F.col("k") / 10.0 - 5, "b2": (F.col("key") % 13) / 3.0 - 2, "b3": F.col("value") / 50.0 - 4,
    }).withColumn("viterbi_gop", F.col("gop") * 1.1 - 0.3)
    return t.select("key", "event", "idx", "grp", "cohort", F.col("target").alias("source"), "pid", "ok", "sub", "del", "s1", "s2", "sub_parts", "accepted",
                    "gop", "viterbi_gop", "b1", "b2", "b3", "gold_error", "gold_event", "realized", "stable_event", "stable_error", "diagnostic", "quality")


EVIDENCE_SQL = """
ev0 AS (SELECT *, 0.5::DOUBLE + k % 10 / 50.0::DOUBLE ok, 0.05::DOUBLE + key % 5 / 100.0::DOUBLE del, pid % 39 + 1 s1, (pid + 6) % 39 + 1 s2,
  CASE WHEN key % 4 = 0 THEN [pid, (pid + 2) % 39 + 1] ELSE [pid] END accepted FROM ptok WHERE diagnostic),
ev AS (SELECT *, 1 - ok - del AS sub, ln(ok / (1 - ok)) gop, ln(ok / (1 - ok)) * 1.1::DOUBLE - 0.3::DOUBLE viterbi_gop, k / 10.0::DOUBLE - 5 b1, key % 13 / 3.0::DOUBLE - 2 b2, value / 50.0::DOUBLE - 4 b3 FROM ev0),
pa AS (SELECT source, max(p) FILTER (WHERE op = 'OK') op_ok, max(p) FILTER (WHERE op = 'SUB') op_sub, max(p) FILTER (WHERE op = 'DEL') op_del FROM ops GROUP BY source),
evp AS (SELECT ev.*, op_ok, op_sub, op_del, q1.p p1, q2.p p2, coalesce(q3.p, 0) p3 FROM ev JOIN pa ON pa.source = ev.target
  JOIN subs q1 ON q1.source = ev.target AND q1.target = nm[s1] JOIN subs q2 ON q2.source = ev.target AND q2.target = nm[s2]
  LEFT JOIN subs q3 ON q3.source = ev.target AND len(accepted) = 2 AND q3.target = nm[accepted[2]])"""


@query("prior_replacement", f"""WITH {PRIOR_SQL}, {EVIDENCE_SQL},
x AS (SELECT key, ok * op_ok / 0.9::DOUBLE o, del * op_del / 0.03::DOUBLE d, 0.6::DOUBLE * sub * op_sub * (p1 / (1 - p3)) / (0.07::DOUBLE / (39 - len(accepted))) m1,
  0.4::DOUBLE * sub * op_sub * (p2 / (1 - p3)) / (0.07::DOUBLE / (39 - len(accepted))) m2 FROM evp)
SELECT key, round(o / (o + d + m1 + m2), 8) cf_ok, round(d / (o + d + m1 + m2), 8) cf_del, round(m1 / (o + d + m1 + m2), 8) cf_s1, round(m2 / (o + d + m1 + m2), 8) cf_s2 FROM x""")
def prior_replacement(spark, sf_dir):
    arrays = stored(pr.prior_arrays(*pr.group_equal_prior(conf(spark, sf_dir))), "prior-arrays")  # one row per symbol
    out = pr.prior_replacement(evidence(spark, sf_dir), arrays)
    out = out.select("key", "cf_ok", "cf_del", F.element_at("cf_sub", F.col("s1").cast("int")).alias("cf_s1"), F.element_at("cf_sub", F.col("s2").cast("int")).alias("cf_s2"))
    return rounded(out, "cf_ok", "cf_del", "cf_s1", "cf_s2")


@query("compact_features", f"""WITH {PRIOR_SQL}, {EVIDENCE_SQL}, {RELIABILITY_SQL},
y AS (SELECT evp.*, reliability r FROM evp JOIN rel ON rel.source = evp.target),
x AS (SELECT key, -gop c1, -viterbi_gop c2, ln(sub / ok) c3, ln(del / ok) c4, ln((op_sub + op_del) / op_ok) - ln(0.1::DOUBLE / 0.9::DOUBLE) c5,
  ln((0.6::DOUBLE * sub * (r * p1 / (1 - p3) + (1 - r) / (39 - len(accepted))) + 0.4::DOUBLE * sub * (r * p2 / (1 - p3) + (1 - r) / (39 - len(accepted)))) / (sub / (39 - len(accepted)))) c6,
  -b1 c7, -b2 c8, -b3 c9 FROM y)
SELECT key, {', '.join(f"round(sign({c}) * ln(1 + abs({c})), 7) + 0.0 AS {n}" for c, n in zip(('c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9'), ('x_score', 'x_best', 'x_sub', 'x_del', 'x_occurrence', 'x_identity', 'x_b1', 'x_b2', 'x_b3')))} FROM x""")
def compact_features(spark, sf_dir):
    c = conf(spark, sf_dir)
    out = pr.compact_features(evidence(spark, sf_dir), stored(pr.prior_arrays(*pr.group_equal_prior(c)), "prior-arrays"),
                              stored(pr.identity_reliability(c, "grp"), "reliability"), ["b1", "b2", "b3"])
    names = ["x_score", "x_best", "x_sub", "x_del", "x_occurrence", "x_identity", "x_b1", "x_b2", "x_b3"]
    return out.select("key", *[(F.round(n, 7) + F.lit(0.0)).alias(n) for n in names])
