"""Registered queries: folds, selection, severity association and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import association as ac
from strophe.operators import detection as det
from strophe.operators import diagnosis as dia
from strophe.operators import folds as fo
from strophe.operators import resampling as rs
from strophe.operators import selection as se
from strophe.plans.q_detection import CURVE, MACRO
from strophe.plans.registry import query, rounded
from strophe.plans.tables import FRAMES_SQL, PTOK_SQL, SCORED_SQL, TOKENS_SQL, frames, phone_tokens, scored, table, tokens

# --- folds and samples -----------------------------------------------------------------------

GROUPS_SQL = TOKENS_SQL + ", g AS (SELECT grp, max(cohort) cohort, row_number() OVER (ORDER BY grp) - 1 i, count(*) OVER () n FROM tokens GROUP BY grp)"


@query("cyclic_folds", f"""WITH {GROUPS_SQL} SELECT f.grp AS fold, g.grp, CASE WHEN g.i = f.i THEN 'test' WHEN g.i = (f.i + 1) % f.n THEN 'development' ELSE 'training' END role FROM g f, g""")
def cyclic_folds(spark, sf_dir):
    return fo.cyclic_folds(tokens(spark, sf_dir), "grp")


@query("nested_folds", f"""WITH {GROUPS_SQL}, c AS (SELECT * FROM g WHERE cohort = 'case'), p AS (SELECT o.grp AS "outer", n.grp AS "inner" FROM c o, c n WHERE o.grp <> n.grp AND n.grp <> 'g05')
SELECT "outer", "inner", g.grp, CASE WHEN cohort = 'case' THEN 'training' ELSE 'control' END role FROM p, g WHERE g.grp NOT IN ("outer", "inner") AND g.grp <> 'g05'
UNION ALL SELECT "outer", "inner", "inner", 'validation' FROM p UNION ALL SELECT grp, NULL, grp, 'test' FROM c""")
def nested_folds(spark, sf_dir):
    """Group g05 has no labels: it is tested but never trains."""
    g = tokens(spark, sf_dir).select("grp", "cohort").distinct()
    return fo.nested_folds(g, "grp", "cohort", "case", F.col("grp") != "g05")


@query("group_weights", f"""WITH {TOKENS_SQL}, c AS (SELECT grp, count(*) ng FROM tokens GROUP BY grp), t AS (SELECT sum(ng) n, count(*) g FROM c)
SELECT grp, ng AS n, round(n::DOUBLE / (g * ng), 8) weight, round(ng * n::DOUBLE / (g * ng), 6) total FROM c, t""")
def group_weights(spark, sf_dir):
    w = fo.group_weights(tokens(spark, sf_dir).select("grp", "key"), "grp")
    out = w.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.sum("weight").alias("total"))
    return rounded(out, "weight").withColumn("total", F.round("total", 6))


@query("round_robin_sample", f"""WITH {TOKENS_SQL}, r AS (SELECT grp, key, row_number() OVER (PARTITION BY grp ORDER BY ('0x' || substr(md5(grp || '-' || key), 1, 8))::BIGINT, key) turn FROM tokens)
SELECT grp, key, turn FROM r ORDER BY turn, grp LIMIT 500""")
def round_robin_sample(spark, sf_dir):
    out = fo.round_robin_sample(tokens(spark, sf_dir).select("grp", "key"), "grp", "key", 500)
    return out.withColumn("turn", F.col("turn").cast("long"))


@query("stratified_median_pick", """WITH e AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n_chars FROM documents), d AS (SELECT source, doc_id, n_chars, CASE WHEN n_chars BETWEEN 1 AND 500 THEN 'short' WHEN n_chars BETWEEN 501 AND 3000 THEN 'medium' WHEN n_chars >= 3001 THEN 'long' ELSE 'outside' END stratum FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY n_chars, doc_id) rn, count(*) OVER (PARTITION BY source, stratum) n FROM d WHERE stratum IS NOT NULL),
own AS (SELECT source, doc_id, n_chars, stratum, 'group' AS scope FROM r WHERE rn = n // 2 + 1),
q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n_chars, doc_id) rn, count(*) OVER (PARTITION BY stratum) n FROM d WHERE stratum IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM own))
SELECT * FROM own UNION ALL SELECT source, doc_id, n_chars, stratum, 'global' FROM q WHERE rn = n // 2 + 1""")
def stratified_median_pick(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return fo.stratified_median_pick(d, "source", "doc_id", "n_chars", {"short": (1, 500), "medium": (501, 3000), "long": (3001, None)})


# --- selection ---------------------------------------------------------------------------------


@query("threshold_search", f"""WITH {SCORED_SQL}, t AS (SELECT unnest(generate_series(1, 99)) / 100.0::DOUBLE t),
f AS (SELECT method, t, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE p_error >= t AND gold_error = 1) / nullif(count(*) FILTER (WHERE p_error >= t) + count(*) FILTER (WHERE gold_error = 1), 0), 0) f1 FROM scored, t GROUP BY ALL),
gg AS (SELECT method, grp, t, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE p_error >= t AND gold_error = 1) / nullif(count(*) FILTER (WHERE p_error >= t) + count(*) FILTER (WHERE gold_error = 1), 0), 0) f1
  FROM scored, (SELECT unnest(generate_series(1, 9)) / 10.0::DOUBLE t) GROUP BY ALL),
m AS (SELECT method, t, avg(f1) f1 FROM gg GROUP BY ALL),
u AS (SELECT 'pooled' AS kind, * FROM f UNION ALL SELECT 'macro', * FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, method ORDER BY round(f1, 12) DESC, round(abs(t - 0.5), 12), t DESC) rn FROM u)
SELECT kind, method, t AS threshold, round(f1, 8) f1 FROM r WHERE rn = 1""")
def threshold_search(spark, sf_dir):
    s = scored(spark, sf_dir)
    pooled = se.threshold_search(s, ["method"], "p_error", "gold_error").select(F.lit("pooled").alias("kind"), "*")
    macro = se.macro_threshold_search(s, ["method"], "grp", "p_error", "gold_error").select(F.lit("macro").alias("kind"), "*")
    return rounded(pooled.unionByName(macro), "f1")


GATES_SQL = """
b AS (SELECT *, coalesce(cand_event = gold_event AND (cand_event = 'deletion' OR cand_symbol = realized), FALSE) ok, cand_event IN ('substitution', 'deletion') named FROM scored),
t10 AS (SELECT round(0.5 + unnest(generate_series(0, 9)) * 0.05, 2)::DOUBLE t), t6 AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95])::DOUBLE t),
x AS (SELECT 'largest_coverage' AS variant, method, t, count(*) FILTER (WHERE stable_event AND p_error >= 0.5 AND cand_margin >= 0.1 AND cand_conf >= t) n,
   count(*) FILTER (WHERE stable_event AND p_error >= 0.5 AND cand_margin >= 0.1 AND cand_conf >= t AND ok) k, count(*) FILTER (WHERE stable_event AND p_error >= 0.5) den,
   count(*) FILTER (WHERE stable_event AND p_error >= 0.5 AND cand_margin >= 0.1 AND cand_conf >= t) c FROM b, t10 GROUP BY ALL
  UNION ALL SELECT 'first_confident', method, t, count(*) FILTER (WHERE stable_event AND predicted AND named AND cand_margin >= 0.1 AND cand_conf >= t),
   count(*) FILTER (WHERE stable_event AND predicted AND named AND cand_margin >= 0.1 AND cand_conf >= t AND ok AND gold_error = 1), count(*) FILTER (WHERE stable_event AND gold_error = 1),
   count(*) FILTER (WHERE stable_event AND predicted AND named AND cand_margin >= 0.1 AND cand_conf >= t AND gold_error = 1) FROM b, t10 GROUP BY ALL
  UNION ALL SELECT 'first_joint', method, t, count(*) FILTER (WHERE stable_event AND predicted AND named AND p_error * cand_conf >= t), count(*) FILTER (WHERE stable_event AND predicted AND named AND p_error * cand_conf >= t AND ok),
   count(*) FILTER (WHERE stable_event AND predicted AND named), count(*) FILTER (WHERE stable_event AND predicted AND named AND p_error * cand_conf >= t) FROM b, t6 GROUP BY ALL),
y AS (SELECT variant, method, t, n, k::DOUBLE / nullif(n, 0) prec, c::DOUBLE / greatest(den, 1) cov FROM x),
z AS (SELECT *, CASE variant WHEN 'first_joint' THEN n >= 5 AND prec >= 0.4 ELSE n > 0 AND prec >= 0.4 AND cov >= 0.1 END good FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY variant, method ORDER BY good DESC NULLS LAST, CASE WHEN variant = 'largest_coverage' THEN -cov END, CASE WHEN variant = 'largest_coverage' THEN -prec END,
   CASE WHEN variant = 'largest_coverage' THEN -t ELSE t END) rn FROM z)"""


@query("gate_search", f"""WITH {SCORED_SQL}, {GATES_SQL}
SELECT variant, method, CASE WHEN good THEN t END gate, round(CASE WHEN good THEN prec END, 8) "precision", round(CASE WHEN good THEN cov END, 8) coverage, CASE WHEN good THEN n END n_selected FROM w WHERE rn = 1""")
def gate_search(spark, sf_dir):
    s, out = scored(spark, sf_dir), None
    for v in ("largest_coverage", "first_confident", "first_joint"):
        g = se.gate_search(s, ["method"], v, precision=0.4).select(F.lit(v).alias("variant"), "*")
        out = g if out is None else out.unionByName(g)
    return rounded(out, "precision", "coverage")


@query("type_threshold_search", f"""WITH {SCORED_SQL}, x AS (SELECT method, t, count(*) FILTER (WHERE gold_event = 'substitution') gs, count(*) FILTER (WHERE gold_event = 'deletion') gd,
 count(*) FILTER (WHERE predicted AND cand_conf >= t) ps, count(*) FILTER (WHERE predicted AND cand_conf < t) pd, count(*) FILTER (WHERE predicted AND cand_conf >= t AND gold_event = 'substitution' AND cand_symbol = realized) ts,
 count(*) FILTER (WHERE predicted AND cand_conf < t AND gold_event = 'deletion') td FROM scored, (VALUES (0.25::DOUBLE), (0.5), (0.75)) g(t) WHERE stable_event GROUP BY ALL),
y AS (SELECT method, t, (2.0::DOUBLE * ts / greatest(gs + ps, 1) + 2.0::DOUBLE * td / greatest(gd + pd, 1)) / 2 m FROM x)
SELECT method, arg_max(t, round(m, 12)) threshold, round(max(m), 8) mean_f1 FROM y GROUP BY method""")
def type_threshold_search(spark, sf_dir):
    return rounded(se.type_threshold_search(scored(spark, sf_dir), ["method"], "cand_conf", "cand_symbol"), "mean_f1")


LAM_CURVE = CURVE.replace("FROM scored", "FROM lam_scored")


@query("grid_select", f"""WITH {TOKENS_SQL}, lam_scored AS (SELECT CAST(l AS VARCHAR) AS method, grp, gold_error, (1 - l) * ((key * 37 + k * 11) % 97 + gold_error * 30) + l * (least(value, 97.0) + gold_error * 30) AS score
  FROM tokens, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) g(l)), {LAM_CURVE},
m AS (SELECT CAST(method AS DOUBLE) lam, avg(ap) ap FROM rank_metrics GROUP BY method)
SELECT lam, round(ap, 8) ap FROM m ORDER BY -round(ap, 12), lam LIMIT 1""")
def grid_select(spark, sf_dir):
    """Mixing weight with the best group-macro average precision; ties go to the smaller weight."""
    t = tokens(spark, sf_dir).select("key", "grp", "gold_error", "k", "value", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])).alias("lam"))
    a = (F.col("key") * 37 + F.col("k") * 11) % 97 + F.col("gold_error") * 30
    b = F.least(F.col("value"), F.lit(97.0)) + F.col("gold_error") * 30
    m = det.ranking_metrics(t.withColumn("score", (1 - F.col("lam")) * a + F.col("lam") * b), ["lam", "grp"], "score", "gold_error")
    macro = m.groupBy("lam").agg(F.avg("ap").alias("ap"))
    return rounded(se.grid_select(macro, [], "ap", ["lam"]), "ap")


@query("temperature_select", f"""WITH {FRAMES_SQL}, c AS (SELECT event % 3 AS fold, event, frame, symbol, v, label % 63 + 1 AS gold, 1 + event % 4 AS w FROM fl WHERE symbol > 0),
s AS (SELECT fold, event, frame, t, max(w) w, ln(sum(exp(v / t))) - max(v / t) FILTER (WHERE symbol = gold) nll FROM c, (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.5), (2.0)) g(t) GROUP BY ALL),
m AS (SELECT fold, t, sum(w * nll) / sum(w) nll FROM s GROUP BY ALL)
SELECT fold, t AS temperature, round(nll, 8) nll FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(nll, 12), t <> 1, abs(t - 1), t) = 1""")
def temperature_select(spark, sf_dir):
    f = frames(spark, sf_dir).select((F.col("event") % 3).alias("fold"), F.slice("logits", 2, F.size("logits") - 1).alias("scores"),
                                     (F.col("label") % 63 + 1).cast("int").alias("gold"), (1 + F.col("event") % 4).cast("double").alias("w"))
    return rounded(se.temperature_select(f, ["fold"], "scores", "gold", "w"), "nll")


@query("weighted_quantile", """WITH v AS (SELECT l_returnflag grp, l_extendedprice v, sum(l_quantity) w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY v) / sum(w) OVER (PARTITION BY grp) s FROM v)
SELECT grp, min(v) FILTER (WHERE s >= 0.9 - 1e-12) quantile FROM c GROUP BY grp""")
def weighted_quantile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice", "l_quantity")
    return se.weighted_quantile(li, ["grp"], "l_extendedprice", "l_quantity", 0.9)


@query("supported_penalty", f"""WITH {PTOK_SQL}, r AS (SELECT target, grp, CAST(value AS DOUBLE) v FROM ptok WHERE gold_error = 0),
n AS (SELECT *, count(*) OVER (PARTITION BY target, grp) ng, count(*) OVER (PARTITION BY target) nt, count(*) OVER (PARTITION BY grp) ag FROM r),
sup AS (SELECT target FROM r GROUP BY target HAVING count(*) >= 20 AND count(DISTINCT grp) >= 2),
a AS (SELECT target, v, sum(1.0::DOUBLE / ng) w FROM n WHERE target IN (SELECT target FROM sup) GROUP BY ALL),
b AS (SELECT *, sum(w) OVER (PARTITION BY target ORDER BY v) / sum(w) OVER (PARTITION BY target) s FROM a),
own AS (SELECT target, min(v) FILTER (WHERE s >= 0.9 - 1e-12) q FROM b GROUP BY target),
ga AS (SELECT v, sum(1.0::DOUBLE / ag) w FROM n GROUP BY v), gb AS (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () s FROM ga), g AS (SELECT min(v) FILTER (WHERE s >= 0.9 - 1e-12) q FROM gb)
SELECT phone AS target, coalesce(own.q, g.q) penalty, own.q IS NULL fallback FROM phones LEFT JOIN own ON own.target = phone, g""")
def supported_penalty(spark, sf_dir):
    from strophe.functions.inventory import phone_table
    t = phone_tokens(spark, sf_dir).where("gold_error = 0").select("target", "grp", "value")
    own, overall = se.supported_penalty(t, "target", "grp", "value")
    every = phone_table(spark).select(F.col("phone").alias("target"))
    return se.with_backoff(every, own, overall, ["target"], "quantile", "penalty")


# --- severity ----------------------------------------------------------------------------------

HIER_SQL = """
h AS (SELECT n_nationkey nation, n_regionkey sev, c_custkey cust, o_orderkey ord, l_quantity q, l_extendedprice / 1000 x FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h1 AS (SELECT nation, sev, cust, ord, avg(q) q, avg(x) x, count(*) n FROM h GROUP BY ALL), h2 AS (SELECT nation, sev, cust, avg(q) q, avg(x) x, sum(n) n, count(*) r FROM h1 GROUP BY ALL),
h3 AS (SELECT nation, sev, avg(q) q, avg(x) x, sum(n) n, sum(r) r, count(*) c FROM h2 GROUP BY ALL)"""


def positions(spark, sf_dir):
    """Positions in recordings (orders) in events (customers) in groups (nations) with a severity."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("sev"), F.col("c_custkey").alias("cust"),
                    F.col("o_orderkey").alias("ord"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("x"))


def _means(spark, sf_dir):
    """Two scores per group, each averaged up the hierarchy in one pass."""
    p = positions(spark, sf_dir)
    long = p.select("sev", "nation", "cust", "ord", F.explode(F.array(F.struct(F.lit("q").alias("m"), F.col("q").alias("v")), F.struct(F.lit("x").alias("m"), F.col("x").alias("v")))).alias("s"))
    long = long.select("sev", "nation", "cust", "ord", F.col("s.m").alias("m"), F.col("s.v").alias("v"))
    up = ac.hierarchical_mean(long, ["nation", "cust", "ord"], "v", by=["m", "sev"])
    return up.groupBy("nation", "sev").agg(F.max(F.when(F.col("m") == "q", F.col("score"))).alias("q"), F.max(F.when(F.col("m") == "x", F.col("score"))).alias("x"))


@query("hierarchical_mean", f"WITH {HIER_SQL} SELECT nation, sev, round(q, 8) score, CAST(n AS BIGINT) n_positions, CAST(r AS BIGINT) n_ord, c n_cust FROM h3")
def hierarchical_mean(spark, sf_dir):
    out = ac.hierarchical_mean(positions(spark, sf_dir), ["nation", "cust", "ord"], "q", by=["sev"])
    return rounded(out, "score")


@query("event_index_collapse", """SELECT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS period, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) recordings,
 count(*) n_recordings, min(o_orderstatus) = max(o_orderstatus) consistent, min(o_orderstatus) o_orderstatus FROM orders GROUP BY ALL""")
def event_index_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("period", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long"))
    out = ac.event_index(o, ["o_custkey", "period"], "o_orderkey", ["o_orderstatus"])
    return out.withColumn("recordings", F.concat_ws(",", F.transform("recordings", lambda x: x.cast("string"))))


CORR_SQL = """
rk AS (SELECT *, rank() OVER (ORDER BY sev) + (count(*) OVER (PARTITION BY sev) - 1) / 2.0::DOUBLE rs, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE rv FROM cs),
pr AS (SELECT sum(sign(a.sev - b.sev) * sign(a.s - b.s)) c, count(*) FILTER (WHERE a.sev <> b.sev) tx, count(*) FILTER (WHERE a.s <> b.s) ty FROM cs a, cs b WHERE a.nation <> b.nation)
SELECT (SELECT count(*) FROM cs) n, round(c / sqrt(tx::DOUBLE * ty), 8) tau, round(abs(c / sqrt(tx::DOUBLE * ty)), 8) abs_tau, round((SELECT corr(rs, rv) FROM rk), 8) spearman, round((SELECT corr(sev, s) FROM cs), 8) pearson FROM pr"""


@query("correlations", f"WITH {HIER_SQL}, cs AS (SELECT nation, sev, q AS s FROM h3), {CORR_SQL}")
def correlations(spark, sf_dir):
    out = ac.correlations(_means(spark, sf_dir), [], "sev", "q").withColumn("n", F.col("n").cast("long"))
    return rounded(out, "tau", "abs_tau", "spearman", "pearson")


@query("position_correlations", f"""WITH {TOKENS_SQL}, cs AS (SELECT grp, k::DOUBLE x, value y FROM tokens),
rk AS (SELECT grp, x, y, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE ry FROM cs),
pr AS (SELECT a.grp, sum(sign(a.x - b.x) * sign(a.y - b.y)) c, count(*) FILTER (WHERE a.x <> b.x) tx, count(*) FILTER (WHERE a.y <> b.y) ty FROM cs a JOIN cs b USING (grp) GROUP BY a.grp),
r AS (SELECT grp, count(*) n, corr(rx, ry) s, corr(x, y) p FROM rk GROUP BY grp)
SELECT grp, n, round(c / sqrt(tx::DOUBLE * ty), 8) tau, round(abs(c / sqrt(tx::DOUBLE * ty)), 8) abs_tau, round(s, 8) spearman, round(p, 8) pearson FROM pr JOIN r USING (grp)""")
def position_correlations(spark, sf_dir):
    """Rank correlations over positions; one group holds over a third of them."""
    out = ac.correlations(tokens(spark, sf_dir), ["grp"], "k", "value")
    return rounded(out, "tau", "abs_tau", "spearman", "pearson")


@query("paired_bootstrap", f"""WITH {SCORED_SQL}, {CURVE},
d AS (SELECT a.grp, a.ap - b.ap d, row_number() OVER (ORDER BY a.grp) - 1 i, count(*) OVER () n FROM rank_metrics a JOIN rank_metrics b USING (grp) WHERE a.method = 'alpha' AND b.method = 'beta'),
z AS (SELECT rep, ('0x' || substr(md5(rep || '-' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM d) i FROM (SELECT unnest(generate_series(0, 9999)) rep), (SELECT i AS slot FROM d)),
m AS (SELECT rep, avg(d) m FROM z JOIN d USING (i) GROUP BY rep)
SELECT round((SELECT avg(d) FROM d), 8) difference, (SELECT count(*) FROM d) n_groups, round(quantile_cont(m, 0.025), 8) ci_low, round(quantile_cont(m, 0.975), 8) ci_high, count(*) replicates FROM m""")
def paired_bootstrap(spark, sf_dir):
    m = det.ranking_metrics(scored(spark, sf_dir), ["method", "grp"], "score", "gold_error")
    wide = m.groupBy("grp").agg(F.max(F.when(F.col("method") == "alpha", F.col("ap"))).alias("a"), F.max(F.when(F.col("method") == "beta", F.col("ap"))).alias("b"))
    return rounded(rs.paired_bootstrap(wide, "grp", "a", "b", 10_000), "difference", "ci_low", "ci_high")


@query("ratio_bootstrap", """WITH c AS (SELECT source, sum(toxic) s, count(*) t FROM labels JOIN documents USING (doc_id) GROUP BY source), d AS (SELECT *, row_number() OVER (ORDER BY source) - 1 i FROM c),
z AS (SELECT rep, ('0x' || substr(md5(rep || '-' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM d) i FROM (SELECT unnest(generate_series(0, 1999)) rep), (SELECT i AS slot FROM d)),
m AS (SELECT rep, sum(s)::DOUBLE / sum(t) r FROM z JOIN d USING (i) GROUP BY rep)
SELECT round((SELECT sum(s)::DOUBLE / sum(t) FROM d), 8) rate, (SELECT count(*) FROM d) n_clusters, round(quantile_cont(r, 0.025), 8) ci_low, round(quantile_cont(r, 0.975), 8) ci_high FROM m""")
def ratio_bootstrap(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = j.groupBy("source").agg(F.sum(F.col("toxic").cast("long")).alias("s"), F.count(F.lit(1)).alias("t"))
    return rounded(rs.ratio_bootstrap(c, "source", "s", "t", 2000), "rate", "ci_low", "ci_high")


@query("stratified_bootstrap", f"""WITH {HIER_SQL},
d AS (SELECT nation, sev::DOUBLE y, q a, x b, row_number() OVER (PARTITION BY sev ORDER BY nation) - 1 j, count(*) OVER (PARTITION BY sev) n FROM h3),
z AS (SELECT rep, y, d.j AS slot, ('0x' || substr(md5(rep || '-' || CAST(y AS INT) || '-' || d.j), 1, 8))::BIGINT % n AS j FROM (SELECT unnest(generate_series(0, 9999)) rep), d),
r AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY z.y, slot) id, d.y, a, b FROM z JOIN d ON d.y = z.y AND d.j = z.j
  UNION ALL SELECT -1, row_number() OVER (ORDER BY nation), y, a, b FROM d),
k AS (SELECT p.rep, sum(sign(p.y - q.y) * sign(p.a - q.a)) / sqrt(count(*) FILTER (WHERE p.y <> q.y)::DOUBLE * count(*) FILTER (WHERE p.a <> q.a)) ta,
   sum(sign(p.y - q.y) * sign(p.b - q.b)) / sqrt(count(*) FILTER (WHERE p.y <> q.y)::DOUBLE * count(*) FILTER (WHERE p.b <> q.b)) tb FROM r p JOIN r q ON p.rep = q.rep AND p.id <> q.id GROUP BY p.rep),
rk AS (SELECT rep, y, a, b, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0::DOUBLE ry, rank() OVER (PARTITION BY rep ORDER BY a) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2.0::DOUBLE ra,
   rank() OVER (PARTITION BY rep ORDER BY b) + (count(*) OVER (PARTITION BY rep, b) - 1) / 2.0::DOUBLE rb FROM r),
c AS (SELECT rep, corr(y, a) - corr(y, b) pearson, corr(ry, ra) - corr(ry, rb) spearman FROM rk GROUP BY rep),
v AS (SELECT rep, 'tau' AS metric, ta - tb AS v FROM k UNION ALL SELECT rep, 'abs_tau', abs(ta) - abs(tb) FROM k UNION ALL SELECT rep, 'spearman', spearman FROM c UNION ALL SELECT rep, 'pearson', pearson FROM c)
SELECT metric, round(max(v) FILTER (WHERE rep = -1), 8) difference, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 8) ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 8) ci_high, count(v) FILTER (WHERE rep >= 0) valid_replicates FROM v GROUP BY metric""")
def stratified_bootstrap(spark, sf_dir):
    return rounded(rs.stratified_bootstrap(_means(spark, sf_dir), "nation", "sev", "q", "x", 10_000), "difference", "ci_low", "ci_high")


@query("sign_flip_test", f"""WITH {SCORED_SQL}, {CURVE},
d AS (SELECT a.grp, a.ap - b.ap d, row_number() OVER (ORDER BY a.grp) - 1 i FROM rank_metrics a JOIN rank_metrics b USING (grp) WHERE a.method = 'alpha' AND b.method = 'gamma'),
p AS (SELECT pat, avg(d * CASE WHEN (pat >> i) & 1 = 1 THEN 1 ELSE -1 END) m FROM (SELECT unnest(generate_series(0, 4095)) pat), d GROUP BY pat)
SELECT round((SELECT avg(d) FROM d), 8) difference, (SELECT count(*) FROM d) n_groups, round(avg(CAST(abs(m) >= abs((SELECT avg(d) FROM d)) - 1e-12 AS INT)), 8) p_two_sided, count(*) n_permutations FROM p""")
def sign_flip_test(spark, sf_dir):
    m = det.ranking_metrics(scored(spark, sf_dir), ["method", "grp"], "score", "gold_error")
    wide = m.groupBy("grp").agg((F.max(F.when(F.col("method") == "alpha", F.col("ap"))) - F.max(F.when(F.col("method") == "gamma", F.col("ap")))).alias("d"))
    return rounded(rs.sign_flip_test(wide, "grp", "d"), "difference", "p_two_sided")


@query("method_swap_test", f"""WITH {HIER_SQL}, g20 AS (SELECT nation % 20 AS g, avg(sev::DOUBLE) y, avg(q) a, avg(x * 0.5) b FROM h3 GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY g) - 1 i FROM g20),
v AS (SELECT i, y, bit, CASE bit WHEN 1 THEN a ELSE b END a, CASE bit WHEN 1 THEN b ELSE a END b FROM d, (VALUES (0), (1)) z(bit)),
t AS (SELECT p.i, q.i AS j, p.bit AS bi, q.bit AS bj, sign(p.y - q.y) * sign(p.a - q.a) fa, CAST(p.a <> q.a AS INT) ga, sign(p.y - q.y) * sign(p.b - q.b) fb, CAST(p.b <> q.b AS INT) gb FROM v p JOIN v q ON p.i > q.i),
pt AS (SELECT unnest(generate_series(0, 1023)) AS pat),
lo AS (SELECT pat, sum(fa) fa, sum(ga) ga, sum(fb) fb, sum(gb) gb FROM pt JOIN t ON i < 10 AND (pat >> i) & 1 = bi AND (pat >> j) & 1 = bj GROUP BY pat),
hi AS (SELECT pat, sum(fa) fa, sum(ga) ga, sum(fb) fb, sum(gb) gb FROM pt JOIN t ON j >= 10 AND (pat >> (i - 10)) & 1 = bi AND (pat >> (j - 10)) & 1 = bj GROUP BY pat),
cr AS (SELECT pat, j, bj, sum(fa) fa, sum(ga) ga, sum(fb) fb, sum(gb) gb FROM pt JOIN t ON i >= 10 AND j < 10 AND (pat >> (i - 10)) & 1 = bi GROUP BY ALL),
lb AS (SELECT pat, j, (pat >> j) & 1 AS bj FROM pt, (SELECT unnest(generate_series(0, 9)) j)),
xs AS (SELECT cr.pat AS h, lb.pat AS l, sum(fa) fa, sum(ga) ga, sum(fb) fb, sum(gb) gb FROM cr JOIN lb USING (j, bj) GROUP BY ALL),
yp AS (SELECT count(*)::DOUBLE AS ty FROM d p JOIN d q ON p.i > q.i AND p.y <> q.y),
k AS (SELECT h * 1024 + l AS pat, (xs.fa + lo.fa + hi.fa) / sqrt(ty * (xs.ga + lo.ga + hi.ga)) ta, (xs.fb + lo.fb + hi.fb) / sqrt(ty * (xs.gb + lo.gb + hi.gb)) tb FROM xs JOIN lo ON lo.pat = l JOIN hi ON hi.pat = h, yp),
w AS (SELECT pat, 'tau' AS metric, ta - tb AS v FROM k UNION ALL SELECT pat, 'abs_tau', abs(ta) - abs(tb) FROM k), o AS (SELECT metric, v AS o FROM w WHERE pat = 1048575)
SELECT metric, round(max(o), 8) + 0.0 AS difference, round(avg(CAST(abs(v) >= abs(o) - 1e-12 AS INT)), 8) p_two_sided, CAST(20 AS BIGINT) n_groups, count(*) n_permutations FROM w JOIN o USING (metric) GROUP BY metric""")
def method_swap_test(spark, sf_dir):
    """All 25 nations, merged to the 20 groups that an exact test takes: 2^20 patterns."""
    g = _means(spark, sf_dir).groupBy((F.col("nation") % 20).alias("g")).agg(
        F.avg(F.col("sev").cast("double")).alias("sev"), F.avg("q").alias("q"), F.avg(F.col("x") * 0.5).alias("b"))
    return rounded(rs.method_swap_test(g, "g", "sev", "q", "b"), "difference", "p_two_sided")


@query("success_rules", f"""WITH {SCORED_SQL}, {MACRO},
del AS (SELECT method, grp, tp::DOUBLE / nullif(pr, 0) "p", tp::DOUBLE / nullif(su, 0) r FROM (SELECT method, grp, count(*) FILTER (WHERE gold_event = 'deletion') su, count(*) FILTER (WHERE p_error >= 0.5 AND cand_event = 'deletion') pr,
  count(*) FILTER (WHERE p_error >= 0.5 AND cand_event = 'deletion' AND gold_event = 'deletion') tp FROM scored WHERE stable_event GROUP BY ALL)),
dm AS (SELECT method, avg(2 * "p" * r / nullif("p" + r, 0)) f FROM del GROUP BY method),
m AS (SELECT method, avg(ap) ap, avg(auroc) auroc, avg(brier) brier, max(f) f, avg(f1) f1 FROM both_ JOIN dm USING (method) GROUP BY method),
i AS (SELECT count(*) FILTER (WHERE a.ap > b.ap) n FROM rank_metrics a JOIN rank_metrics b USING (grp) WHERE a.method = 'alpha' AND b.method = 'beta'),
o AS (SELECT a.ap >= (SELECT max(ap) FROM m) - 1e-12 c1, a.ap - b.ap >= 0.03 c2, i.n >= 4 c3, a.auroc - b.auroc >= -0.01 c4, a.brier - b.brier <= 0.01 c5, a.f1 - b.f1 >= -0.01 c6, a.f - b.f >= -0.01 c7, a.ap - b.ap d FROM m a, m b, i WHERE a.method = 'alpha' AND b.method = 'beta')
SELECT unnest(['highest_macro_ap','ap_gain','groups_improved','auroc_kept','brier_kept','top1_kept','deletion_f1_kept']) AS "check", unnest([c1,c2,c3,c4,c5,c6,c7]) passed,
  CASE WHEN d IS NULL THEN 'not_evaluable' WHEN c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 THEN 'success' ELSE 'not_met' END verdict, round(d, 8) ap_difference FROM o""")
def success_rules(spark, sf_dir):
    s, keys = scored(spark, sf_dir), ["method", "grp"]
    per = det.token_metrics(s, keys, label="gold_error").join(dia.deletion_prf(s, keys).select(*keys, F.col("f1").alias("del_f1")), keys, "left")
    macro = per.groupBy("method").agg(F.avg("ap").alias("ap"), F.avg("auroc").alias("auroc"), F.avg("brier").alias("brier"), F.avg("f1").alias("top1"), F.avg("del_f1").alias("del_f1"))
    wide = per.groupBy("grp").agg(F.max(F.when(F.col("method") == "alpha", F.col("ap"))).alias("a"), F.max(F.when(F.col("method") == "beta", F.col("ap"))).alias("b"))
    improved = wide.agg(F.count_if(F.col("a") > F.col("b")).alias("n_improved"))
    return rounded(rs.success_rules(macro, improved, "alpha", "beta"), "ap_difference")
