"""Registered queries: vector scalars, candidate selection and frame-lattice scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import scalars as sc
from strophe.functions import vectors as vx
from strophe.operators import candidates as ca
from strophe.operators import lattice as la
from strophe.plans.registry import query, rounded
from strophe.session import keyed, shuffle_width
from strophe.plans.tables import FRAMES_SQL, N_CLASSES, TOKENS_SQL, frames, table, tokens

IDS = list(range(1, N_CLASSES))


def logp_frames(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("logp", vx.log_softmax(F.col("logits")))


def matrices(spark, sf_dir):
    return la.frame_matrix(keyed(logp_frames(spark, sf_dir), "event"), "event", "frame", "logp")


def targets(spark, sf_dir):
    """Reference sequence of an event: 3 to 5 symbols from the labels of its first frames."""
    f = frames(spark, sf_dir).where(F.col("frame") < 3 + F.col("event") % 3)
    rows = F.array_sort(F.collect_list(F.struct("frame", (F.col("label") % 63 + 1).cast("int").alias("s"))))
    return f.groupBy("event").agg(F.transform(rows, lambda r: r["s"]).alias("labels"))


TARGETS_SQL = FRAMES_SQL + """,
tg AS (SELECT event, list(CAST(label % 63 + 1 AS INT) ORDER BY frame) AS labels FROM fr WHERE frame < 3 + event % 3 GROUP BY event),
nf AS (SELECT event, count(*) AS n FROM fr GROUP BY event)"""


def _forward_sql(seqs: str, key: str) -> str:
    """Recursive statement of the forward recursion for the sequences in CTE ``seqs`` (event, ``key``, labels)."""
    return f"""
st AS (SELECT event, {key}, s, CASE WHEN s % 2 = 1 THEN labels[(s + 1) // 2] ELSE 0 END AS sym, 2 * len(labels) + 1 AS ns,
   s >= 2 AND s % 2 = 1 AND (s < 3 OR labels[(s + 1) // 2] <> labels[(s - 1) // 2]) AS skip
   FROM (SELECT *, unnest(generate_series(0, 2 * len(labels))) AS s FROM {seqs})),
fw AS (SELECT st.event, {key}, 0 AS t, list(CASE WHEN s <= 1 THEN exp(logp) ELSE 0 END ORDER BY s) AS a FROM st JOIN lp ON lp.event = st.event AND lp.frame = 0 AND lp.symbol = sym GROUP BY st.event, {key}
 UNION ALL SELECT x.event, x.{key}, x.t, x.a FROM (SELECT st.event, st.{key}, fw.t + 1 AS t,
   list(exp(logp) * (fw.a[s + 1] + CASE WHEN s >= 1 THEN fw.a[s] ELSE 0 END + CASE WHEN skip THEN fw.a[s - 1] ELSE 0 END) ORDER BY s) AS a
   FROM fw JOIN st ON st.event = fw.event AND st.{key} = fw.{key} JOIN lp ON lp.event = fw.event AND lp.frame = fw.t + 1 AND lp.symbol = st.sym GROUP BY st.event, st.{key}, fw.t) x),
ll AS (SELECT fw.event, fw.{key}, CASE WHEN len(a) = 1 THEN a[1] ELSE a[len(a)] + a[len(a) - 1] END AS p FROM fw JOIN nf ON nf.event = fw.event WHERE fw.t = nf.n - 1)"""


@query("log_softmax", f"WITH {FRAMES_SQL} SELECT event, frame, symbol, round(logp, 8) logp FROM lp")
def log_softmax(spark, sf_dir):
    f = logp_frames(spark, sf_dir).select("event", "frame", F.posexplode("logp").alias("symbol", "logp"))
    return rounded(f.withColumn("symbol", F.col("symbol").cast("long")), "logp")


@query("affine_logits", f"""WITH {FRAMES_SQL},
w AS (SELECT i, j, CASE WHEN i = j THEN 0.8::DOUBLE ELSE 0.0 END + ((i * 3 + j * 5) % 7 - 3) / 50.0::DOUBLE AS w FROM (SELECT unnest(generate_series(0, 63)) i), (SELECT unnest(generate_series(0, 63)) j))
SELECT event, frame, i AS symbol, round(sum(w * v) + i / 10.0::DOUBLE, 8) AS value FROM fl JOIN w ON w.j = fl.symbol GROUP BY event, frame, i""")
def affine_logits(spark, sf_dir):
    """A fitted linear recalibration (matrix and bias) applied to every frame."""
    rows = [[(0.8 if i == j else 0.0) + ((i * 3 + j * 5) % 7 - 3) / 50.0 for j in range(N_CLASSES)] for i in range(N_CLASSES)]
    matrix = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    bias = F.array(*[F.lit(i / 10.0) for i in range(N_CLASSES)])
    f = frames(spark, sf_dir).select("event", "frame", F.posexplode(vx.affine(matrix, bias, F.col("logits"))).alias("symbol", "value"))
    return rounded(f.withColumn("symbol", F.col("symbol").cast("long")), "value")


@query("entropy_stats", f"""WITH {FRAMES_SQL},
fq AS (SELECT event, frame, symbol, v * 0.5 AS v FROM fl), fqm AS (SELECT *, max(v) OVER (PARTITION BY event, frame) mx FROM fq),
lq AS (SELECT event, frame, v - mx - ln(sum(exp(v - mx)) OVER (PARTITION BY event, frame)) AS q FROM fqm),
a AS (SELECT event, sum(-exp(logp) * logp) / count(DISTINCT frame) h0 FROM lp GROUP BY event), b AS (SELECT event, sum(-exp(q) * q) / count(DISTINCT frame) h1 FROM lq GROUP BY event)
SELECT event, round(h0, 8) before, round(h1, 8) after, h1 - h0 > 0.25 OR h1 / greatest(h0, 2.220446049250313e-16) >= 4 AS unsafe FROM a JOIN b USING (event)""")
def entropy_stats(spark, sf_dir):
    """Mean frame entropy before and after a recalibration, with the flattening guard."""
    f = frames(spark, sf_dir)
    h = lambda x: vx.let(vx.log_softmax(x), vx.entropy)
    out = f.groupBy("event").agg(F.avg(h(F.col("logits"))).alias("before"),
                                 F.avg(h(F.transform("logits", lambda v: v * 0.5))).alias("after"))
    unsafe = (F.col("after") - F.col("before") > 0.25) | (F.col("after") / F.greatest(F.col("before"), F.lit(2.220446049250313e-16)) >= 4)
    return rounded(out.withColumn("unsafe", unsafe), "before", "after")


@query("signed_log", "SELECT o_orderkey, round(sign(x) * ln(1 + abs(x)), 8) + 0.0 AS value FROM (SELECT o_orderkey, o_totalprice - 150000 AS x FROM orders)")
def signed_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.round(sc.signed_log(F.col("o_totalprice") - 150000), 8) + F.lit(0.0)).alias("value"))
    return o


@query("log_ratio", "SELECT event_id, round(ln(greatest(a, 1e-300)) - ln(greatest(b, 1e-300)), 6) + 0.0 AS value FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END a, CASE WHEN event_id % 11 = 0 THEN 0 ELSE value + 1 END b FROM events)")
def log_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value"))
    b = F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("value") + 1)
    return e.select("event_id", (F.round(sc.log_ratio(a, b), 6) + F.lit(0.0)).alias("value"))


@query("logsumexp_agg", """SELECT l_orderkey, count(*) n, round(max(l_quantity) + ln(sum(exp(l_quantity - m))), 8) lse, round(max(l_quantity) + ln(sum(exp(l_quantity - m)) / count(*)), 8) lme
FROM (SELECT l_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) m FROM lineitem) GROUP BY l_orderkey""")
def logsumexp_agg(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return rounded(la.logsumexp_by(li, ["l_orderkey"], "l_quantity"), "lse", "lme")


@query("json_roundtrip", f"""WITH {TOKENS_SQL} SELECT key, grp, target, realized, k, stable_event FROM tokens""")
def json_roundtrip(spark, sf_dir):
    """Nested records to canonical JSON text (keys in order) and back through the declared schema."""
    t = tokens(spark, sf_dir).select("key", F.to_json(F.struct(
        "grp", F.struct("k", "realized", "stable_event", "target").alias("label"), F.array("target", "realized").alias("pair"))).alias("doc"))
    schema = "grp string, label struct<k: bigint, realized: string, stable_event: boolean, target: string>, pair array<string>"
    return t.select("key", F.from_json("doc", schema).alias("d")).select(
        "key", "d.grp", "d.label.target", "d.label.realized", "d.label.k", "d.label.stable_event")


@query("frame_topk", f"""WITH {FRAMES_SQL}, r AS (SELECT event, symbol, logp, row_number() OVER (PARTITION BY event, frame ORDER BY exp(logp) DESC, symbol) rn FROM lp WHERE symbol > 0)
SELECT DISTINCT event, symbol FROM r WHERE rn <= 2 AND exp(logp) >= 0.01""")
def frame_topk(spark, sf_dir):
    return ca.frame_topk(logp_frames(spark, sf_dir), "event", "logp").withColumn("symbol", F.col("symbol").cast("long"))


MASS_SQL = FRAMES_SQL + """, mass AS (SELECT event, symbol, sum(exp(logp)) mass FROM lp WHERE symbol > 0 GROUP BY ALL),
cov AS (SELECT event, symbol, mass, coalesce(sum(mass) OVER (PARTITION BY event ORDER BY mass DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(mass) OVER (PARTITION BY event) t FROM mass),
cover AS (SELECT event, symbol, mass FROM cov WHERE b < 0.99::DOUBLE * t)"""


@query("mass_cover", f"WITH {MASS_SQL} SELECT event, symbol, round(mass, 8) mass FROM cover")
def mass_cover(spark, sf_dir):
    m = ca.symbol_mass(logp_frames(spark, sf_dir), "event", "logp")
    return rounded(ca.mass_cover(m, "event", 0.99).withColumn("symbol", F.col("symbol").cast("long")), "mass")


@query("retained_mass", f"""WITH {MASS_SQL} SELECT m.event, count(c.symbol) n_selected, round(coalesce(sum(c.mass) / sum(m.mass), 1), 8) retained
FROM mass m LEFT JOIN cover c ON c.event = m.event AND c.symbol = m.symbol GROUP BY m.event""")
def retained_mass(spark, sf_dir):
    m = ca.symbol_mass(logp_frames(spark, sf_dir), "event", "logp")
    return rounded(ca.retained_mass(m, ca.mass_cover(m, "event", 0.99), "event"), "retained")


NEIGHBORS_SQL = "nb AS (SELECT s AS source, [CAST(s % 63 + 1 AS INT), CAST((s * 2) % 63 + 1 AS INT)] AS targets FROM (SELECT unnest(generate_series(1, 63)) s))"


@query("candidate_sets", f"""WITH {TARGETS_SQL}, {NEIGHBORS_SQL},
r AS (SELECT event, symbol, logp, row_number() OVER (PARTITION BY event, frame ORDER BY exp(logp) DESC, symbol) rn FROM lp WHERE symbol > 0),
act AS (SELECT event, list_sort(list_distinct(list(CAST(symbol AS INT)))) active FROM r WHERE rn <= 2 AND exp(logp) >= 0.01 GROUP BY event),
p AS (SELECT event, unnest(labels) s, unnest(generate_series(0, len(labels) - 1)) position FROM tg),
q AS (SELECT event, position, CASE WHEN event % 2 = 0 AND position = 0 AND s % 63 + 1 <> s THEN [s, s % 63 + 1] ELSE [s] END accepted FROM p),
u AS (SELECT q.event, position, accepted, active, list_concat(coalesce((SELECT targets FROM nb WHERE source = accepted[1]), []), coalesce((SELECT targets FROM nb WHERE source = accepted[2]), [])) extra FROM q JOIN act USING (event))
SELECT event, position, array_to_string(accepted, ',') accepted, array_to_string(list_sort(list_filter(list_distinct(list_concat(active, extra)), lambda x: NOT list_contains(accepted, x))), ',') substitutions,
 array_to_string(active, ',') insertions FROM u""")
def candidate_sets(spark, sf_dir):
    act = ca.frame_topk(logp_frames(spark, sf_dir), "event", "logp")
    pos = targets(spark, sf_dir).select("event", F.posexplode("labels").alias("position", "s"))
    other = F.col("s") % 63 + 1
    pos = pos.select("event", F.col("position").cast("long").alias("position"),
                     F.when((F.col("event") % 2 == 0) & (F.col("position") == 0) & (other != F.col("s")), F.array("s", other)).otherwise(F.array("s")).alias("accepted"))
    nb = spark.range(1, N_CLASSES).select(F.col("id").cast("int").alias("source"), F.array((F.col("id") % 63 + 1).cast("int"), ((F.col("id") * 2) % 63 + 1).cast("int")).alias("targets"))
    out = ca.candidate_sets(pos, act, nb, "event")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))).alias(c)
    return out.select("event", "position", text("accepted"), text("substitutions"), text("insertions"))


@query("content_dedup", f"""WITH {TOKENS_SQL}, j AS (SELECT event, string_agg(target, ' ' ORDER BY idx) AS seq, grp FROM tokens GROUP BY ALL)
SELECT grp, count(*) n_routes, count(DISTINCT seq) n_jobs_used, (SELECT count(DISTINCT seq) FROM j) n_jobs FROM j GROUP BY grp""")
def content_dedup(spark, sf_dir):
    t = tokens(spark, sf_dir).groupBy("event", "grp").agg(F.array_sort(F.collect_list(F.struct("idx", "target"))).alias("s"))
    t = t.withColumn("seq", F.transform("s", lambda x: x["target"])).drop("s")
    jobs, routes = ca.content_dedup(t, ["seq"])
    # Each distinct job is "computed" once (here: its length) and routed back to every event.
    done = jobs.select("job_key", F.size("seq").alias("length"))
    total = done.agg(F.count(F.lit(1)).alias("n_jobs"))
    out = routes.join(done, "job_key").groupBy("grp").agg(F.count("length").alias("n_routes"), F.count_distinct("job_key").alias("n_jobs_used"))
    return out.crossJoin(total)


CANDS_SQL = FRAMES_SQL + """,
cd AS (SELECT event, frame AS position, CASE WHEN symbol = 0 THEN -1 ELSE symbol END AS candidate, logp AS log_score, label % 63 + 1 AS target FROM lp),
cn AS (SELECT event, position, log_score AS canonical FROM cd WHERE candidate = target),
cands AS (SELECT cd.*, canonical, (candidate + 3) / 60.0::DOUBLE AS prior FROM cd JOIN cn USING (event, position) WHERE candidate <> target)"""


def cand_scores(spark, sf_dir):
    """Long candidate table: one position per frame, blank as the deletion, the label as canonical."""
    f = logp_frames(spark, sf_dir).withColumn("target", F.col("label") % 63 + 1)
    f = f.withColumn("canonical", F.element_at("logp", (F.col("target") + 1).cast("int")))
    c = f.select("event", F.col("frame").alias("position"), "target", "canonical", F.posexplode("logp").alias("candidate", "log_score"))
    c = c.where("candidate <> target").withColumn("candidate", F.when(F.col("candidate") == 0, -1).otherwise(F.col("candidate")))
    return c.withColumn("prior", (F.col("candidate") + 3) / 60.0)


ROW = ["event", "position"]


@query("ranked_candidates", f"""WITH {CANDS_SQL},
p AS (SELECT event, position, candidate, exp(log_score) / sum(exp(log_score)) OVER (PARTITION BY event, position) prob FROM cands),
r AS (SELECT *, row_number() OVER (PARTITION BY event, position ORDER BY prob DESC, candidate) rn FROM p)
SELECT event, position, CAST(max(candidate) FILTER (WHERE rn = 1) AS BIGINT) top, round(max(prob), 8) p_top, round(max(prob) - max(prob) FILTER (WHERE rn = 2), 8) margin, round(-sum(prob * ln(greatest(prob, 1e-300))), 8) entropy FROM r GROUP BY event, position""")
def ranked_candidates(spark, sf_dir):
    c = la.softmax_temperature(cand_scores(spark, sf_dir), ROW, "log_score", 1.0)
    out = ca.ranked_candidates(c, ROW).withColumn("top", F.col("top").cast("long"))
    return rounded(out, "p_top", "margin", "entropy")


@query("softmax_temperature", f"""WITH {CANDS_SQL}
SELECT event, position, CAST(candidate AS BIGINT) candidate, round(coalesce(exp(log_score / 1.5) FILTER (WHERE candidate <> 3), 0) / sum(exp(log_score / 1.5)) FILTER (WHERE candidate <> 3) OVER (PARTITION BY event, position), 8) prob FROM cands
""".replace("coalesce(exp(log_score / 1.5) FILTER (WHERE candidate <> 3), 0)", "CASE WHEN candidate = 3 THEN 0 ELSE exp(log_score / 1.5::DOUBLE) END").replace("sum(exp(log_score / 1.5))", "sum(exp(log_score / 1.5::DOUBLE))"))
def softmax_temperature(spark, sf_dir):
    """Candidate 3 is impossible everywhere: it gets probability zero."""
    c = cand_scores(spark, sf_dir).withColumn("log_score", F.when(F.col("candidate") != 3, F.col("log_score")))
    out = la.softmax_temperature(c, ROW, "log_score", 1.5)
    return rounded(out.select(*ROW, F.col("candidate").cast("long").alias("candidate"), "prob"), "prob")


@query("agreed_set", f"""WITH {TOKENS_SQL}, a AS (SELECT event, idx FROM tokens WHERE key % 3 = 0), b AS (SELECT event, idx FROM tokens WHERE k % 4 = 0)
SELECT coalesce(a.event, b.event) event, coalesce(a.idx, b.idx) idx, CASE WHEN a.event IS NULL THEN 'only_b' WHEN b.event IS NULL THEN 'only_a' ELSE 'both' END side FROM a FULL JOIN b ON a.event = b.event AND a.idx = b.idx""")
def agreed_set(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return ca.agreed_set(t.where("key % 3 = 0"), t.where("k % 4 = 0"), ["event", "idx"])


@query("src_frame_table", f"""WITH {FRAMES_SQL}, want AS (SELECT DISTINCT event FROM fr UNION ALL SELECT event + 100000 FROM fr WHERE frame = 0 AND event % 7 = 0)
SELECT w.event, count(fr.frame) n_frames, count(fr.frame) = 0 AS missing, round(coalesce(sum(fr.logits[1]), 0), 8) + 0.0 first_class FROM want w LEFT JOIN fr ON fr.event = w.event GROUP BY w.event""")
def src_frame_table(spark, sf_dir):
    from strophe.sources.frames import load_matrices
    f = frames(spark, sf_dir)
    want = f.select("event").distinct().unionByName(f.where("frame = 0 AND event % 7 = 0").select((F.col("event") + 100000).alias("event")))
    out = load_matrices(f.select("event", "frame", "logits"), want)
    first = vx.total(F.transform("matrix", lambda r: F.get(r, F.lit(0))))
    return out.select("event", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), "missing", (F.round(F.coalesce(first, F.lit(0.0)), 8) + F.lit(0.0)).alias("first_class"))


@query("greedy_collapse", f"""WITH {FRAMES_SQL}, b AS (SELECT event, frame, arg_max(symbol, logp * 1.0 - symbol * 1e-15) s FROM lp GROUP BY ALL),
c AS (SELECT *, lag(s) OVER (PARTITION BY event ORDER BY frame) prev FROM b)
SELECT event, coalesce(string_agg(CAST(s AS VARCHAR), ',' ORDER BY frame) FILTER (WHERE s <> 0 AND (prev IS NULL OR prev <> s)), '') symbols FROM c GROUP BY event""")
def greedy_collapse(spark, sf_dir):
    m = matrices(spark, sf_dir).withColumn("g", la.greedy_symbols(F.col("matrix")))
    return m.select("event", F.concat_ws(",", F.transform("g", lambda v: v.cast("string"))).alias("symbols"))


@query("min_frames", f"""WITH {TARGETS_SQL}, d AS (SELECT event, len(labels) n, len(list_filter(generate_series(1, len(labels) - 1), lambda i: labels[i] = labels[i + 1])) r FROM tg)
SELECT event, CAST(n + r AS BIGINT) needed, CASE WHEN n + r > 4 THEN 'too_few_frames' END AS reason FROM d""")
def min_frames(spark, sf_dir):
    t = targets(spark, sf_dir).withColumn("needed", la.min_frames(F.col("labels")).cast("long"))
    return t.select("event", "needed", F.when(F.col("needed") > 4, "too_few_frames").alias("reason"))


@query("ctc_forward", f"WITH RECURSIVE {TARGETS_SQL}, sq AS (SELECT event, 0 AS q, labels FROM tg), {_forward_sql('sq', 'q')} SELECT event, round(ln(p), 7) log_likelihood FROM ll")
def ctc_forward(spark, sf_dir):
    j = matrices(spark, sf_dir).join(targets(spark, sf_dir), "event")
    return j.select("event", F.round(la.forward_log_likelihood(F.col("matrix"), F.col("labels")), 7).alias("log_likelihood"))


@query("path_count_correction", f"""WITH {TARGETS_SQL}, d AS (SELECT event, nf.n t, len(labels) u, len(list_filter(generate_series(1, len(labels) - 1), lambda i: labels[i] = labels[i + 1])) r FROM tg JOIN nf USING (event))
SELECT event, CASE WHEN t >= u + r THEN round(lgamma(t + u - r + 1) - lgamma(2 * u + 1) - lgamma(t - u - r + 1), 7) END log_paths FROM d""")
def path_count_correction(spark, sf_dir):
    j = matrices(spark, sf_dir).join(targets(spark, sf_dir), "event")
    return j.select("event", F.round(la.path_count(F.col("n_frames"), F.col("labels")), 7).alias("log_paths"))


CF_SQL = TARGETS_SQL + """,
cs AS (SELECT event, position, candidate, list_concat(labels[1:position], CASE WHEN candidate = -1 THEN [] ELSE [CAST(candidate AS INT)] END, labels[position + 2:]) AS labels FROM
  (SELECT event, labels, unnest(generate_series(0, len(labels) - 1)) position FROM tg), (SELECT unnest(list_concat(generate_series(1, 63), [-1])) candidate) WHERE candidate <> labels[position + 1]
  UNION ALL SELECT event, -1, -2, labels FROM tg),
cq AS (SELECT *, array_to_string(labels, ',') AS q FROM cs), sq AS (SELECT DISTINCT event, q, labels FROM cq),""" + _forward_sql("sq", "q") + """,
cf AS (SELECT cq.event, position, candidate, cq.q, ln(nullif(p, 0)) AS s FROM cq JOIN ll ON ll.event = cq.event AND ll.q = cq.q)"""


def cf_scores(spark, sf_dir):
    return la.counterfactual_scores(matrices(spark, sf_dir), targets(spark, sf_dir), "event", "labels", IDS, shuffle_width(spark))


@query("counterfactual_scores", f"WITH RECURSIVE {CF_SQL} SELECT event, CAST(position AS BIGINT) position, CAST(candidate AS BIGINT) candidate, round(s, 7) log_score FROM cf")
def counterfactual_scores(spark, sf_dir):
    c = cf_scores(spark, sf_dir)
    return c.select("event", F.coalesce("position", F.lit(-1)).cast("long").alias("position"), F.coalesce("candidate", F.lit(-2)).cast("long").alias("candidate"),
                    F.round("log_score", 7).alias("log_score"))


@query("max_alternative_score", f"""WITH {CANDS_SQL}, al AS (SELECT s AS target, t AS candidate FROM (SELECT unnest(generate_series(1, 63)) s), (SELECT unnest(generate_series(1, 63)) t) WHERE s <> t AND (s + t) % 3 = 0)
SELECT c.event, c.position, round(max(canonical) - max(log_score) FILTER (WHERE al.target IS NOT NULL), 8) restricted, round(max(canonical) - max(log_score), 8) unrestricted
FROM cands c LEFT JOIN al ON al.target = c.target AND al.candidate = c.candidate GROUP BY c.event, c.position""")
def max_alternative_score(spark, sf_dir):
    c = cand_scores(spark, sf_dir)
    s = spark.range(1, N_CLASSES).select(F.col("id").alias("target")).crossJoin(spark.range(1, N_CLASSES).select(F.col("id").alias("candidate")))
    allowed = s.where("target <> candidate AND (target + candidate) % 3 = 0")
    a = la.max_alternative(c, ROW, "canonical", "log_score", allowed, ["target", "candidate"]).withColumnRenamed("gop", "restricted")
    b = la.max_alternative(c, ROW, "canonical", "log_score").withColumnRenamed("gop", "unrestricted")
    return rounded(a.join(b, ROW), "restricted", "unrestricted")


@query("segmentation_free_score", f"""WITH RECURSIVE {CF_SQL}, c0 AS (SELECT event, s AS canonical FROM cf WHERE position = -1), d AS (SELECT DISTINCT event, position, q, s FROM cf WHERE position >= 0 AND s IS NOT NULL)
SELECT event, CAST(position AS BIGINT) position, round(max(canonical), 7) canonical, round(max(canonical) - ln(sum(exp(s))), 7) gop FROM d JOIN c0 USING (event) GROUP BY event, position""")
def segmentation_free_score(spark, sf_dir):
    out = la.segmentation_free(cf_scores(spark, sf_dir), "event")
    return out.select("event", F.col("position").cast("long").alias("position"), F.round("canonical", 7).alias("canonical"), F.round("gop", 7).alias("gop"))


@query("likelihood_ratio", f"""WITH {CANDS_SQL}, w AS (SELECT *, log_score - CASE WHEN candidate = -1 THEN target / 4.0::DOUBLE ELSE 0 END + ln(prior) w FROM cands),
n AS (SELECT *, ln(sum(exp(w)) OVER (PARTITION BY event, position)) mix FROM w)
SELECT event, position, CAST(candidate AS BIGINT) candidate, round(canonical - mix, 8) gop, round(exp(w - mix), 8) posterior FROM n""")
def likelihood_ratio(spark, sf_dir):
    c = cand_scores(spark, sf_dir).withColumn("penalty", F.col("target") / 4.0)
    out = la.likelihood_ratio(c, ROW, "canonical", "log_score", "prior", "penalty")
    return rounded(out.select(*ROW, F.col("candidate").cast("long").alias("candidate"), "gop", "posterior"), "gop", "posterior")


@query("event_posterior", f"""WITH {CANDS_SQL}, a AS (SELECT event, position, 0.9::DOUBLE * exp(max(canonical)) ok, 0.07::DOUBLE / count(*) FILTER (WHERE candidate <> -1) * sum(exp(log_score)) FILTER (WHERE candidate <> -1) s,
 0.03::DOUBLE * sum(exp(log_score)) FILTER (WHERE candidate = -1) d FROM cands GROUP BY ALL)
SELECT event, position, round(ok / (ok + s + d), 8) p_ok, round(s / (ok + s + d), 8) p_sub, round(d / (ok + s + d), 8) p_del, round(ln(ok) - ln(s + d), 8) log_odds FROM a""")
def event_posterior(spark, sf_dir):
    return rounded(la.event_posterior(cand_scores(spark, sf_dir), ROW, "canonical", "log_score"), "p_ok", "p_sub", "p_del", "log_odds")


def paths(spark, sf_dir):
    j = matrices(spark, sf_dir).join(targets(spark, sf_dir), "event")
    return j.select("event", "labels", la.viterbi_path(F.col("matrix"), F.col("labels")).alias("v")).where("v IS NOT NULL").select("event", "labels", "v.path", "v.score")


VITERBI_SQL = TARGETS_SQL + """,
st AS (SELECT event, s, CASE WHEN s % 2 = 1 THEN labels[(s + 1) // 2] ELSE 0 END AS sym, 2 * len(labels) + 1 AS ns, s >= 2 AND s % 2 = 1 AND (s < 3 OR labels[(s + 1) // 2] <> labels[(s - 1) // 2]) AS skip
  FROM (SELECT *, unnest(generate_series(0, 2 * len(labels))) AS s FROM tg)),
vt AS (SELECT st.event, 0 AS t, list(CASE WHEN s <= 1 THEN logp ELSE -1e300::DOUBLE END ORDER BY s) AS v, list(CAST(s AS VARCHAR) ORDER BY s) AS p FROM st JOIN lp ON lp.event = st.event AND lp.frame = 0 AND lp.symbol = sym GROUP BY st.event
 UNION ALL SELECT z.event, z.t, z.v, z.p FROM (SELECT event, t, list(CASE WHEN best <= -1e299 THEN -1e300::DOUBLE ELSE best + logp END ORDER BY s) AS v, list(p[s + 1 - mv] || ',' || s ORDER BY s) AS p FROM
   (SELECT *, CASE mv WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS best FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS mv FROM
     (SELECT vt.event, vt.t + 1 AS t, st.s, logp, vt.p, vt.v[s + 1] AS a, CASE WHEN s >= 1 THEN vt.v[s] ELSE -1e300::DOUBLE END AS b, CASE WHEN skip THEN vt.v[s - 1] ELSE -1e300::DOUBLE END AS c
      FROM vt JOIN st ON st.event = vt.event JOIN lp ON lp.event = vt.event AND lp.frame = vt.t + 1 AND lp.symbol = st.sym) y) x) w GROUP BY event, t) z),
en AS (SELECT vt.event, v, p, CASE WHEN v[len(v) - 1] > v[len(v)] THEN len(v) - 1 ELSE len(v) END AS e FROM vt JOIN nf ON nf.event = vt.event WHERE vt.t = nf.n - 1)"""


@query("viterbi_states", f"WITH RECURSIVE {VITERBI_SQL} SELECT event, p[e] AS path, round(v[e], 7) AS score FROM en WHERE v[e] > -1e299")
def viterbi_states(spark, sf_dir):
    p = paths(spark, sf_dir)
    return p.select("event", F.concat_ws(",", F.transform("path", lambda s: s.cast("string"))).alias("path"), F.round("score", 7).alias("score"))


@query("variant_marginal", f"""WITH RECURSIVE {TARGETS_SQL},
first_ AS (SELECT event, labels, unnest(CASE WHEN event % 2 = 0 AND labels[1] % 63 + 1 <> labels[1] THEN [labels[1], CAST(labels[1] % 63 + 1 AS INT)] ELSE [labels[1]] END) AS c0,
  CASE WHEN event % 2 = 0 THEN [labels[1], CAST(labels[1] % 63 + 1 AS INT)] ELSE [labels[1]] END AS own FROM tg),
cs AS (SELECT event, -1 AS position, -2 AS candidate, list_concat([c0], labels[2:]) AS labels FROM first_
 UNION SELECT event, 0, c, list_concat(CASE WHEN c = -1 THEN [] ELSE [CAST(c AS INT)] END, labels[2:]) FROM first_, (SELECT unnest(list_concat(generate_series(1, 63), [-1])) c) WHERE NOT list_contains(own, c)
 UNION SELECT event, i, c, list_concat([c0], labels[2:i], CASE WHEN c = -1 THEN [] ELSE [CAST(c AS INT)] END, labels[i + 2:]) FROM (SELECT *, unnest(generate_series(1, len(labels) - 1)) AS i FROM first_), (SELECT unnest(list_concat(generate_series(1, 63), [-1])) c) WHERE labels[i + 1] <> c),
cq AS (SELECT *, array_to_string(labels, ',') AS q FROM cs), sq AS (SELECT DISTINCT event, q, labels FROM cq), {_forward_sql("sq", "q")},
sc AS (SELECT cq.event, position, candidate, ln(sum(p) / count(*)) AS s FROM cq JOIN ll ON ll.event = cq.event AND ll.q = cq.q GROUP BY ALL HAVING sum(p) > 0),
nm AS (SELECT event, s AS normal FROM sc WHERE position = -1)
SELECT event, CAST(position AS BIGINT) position, round(normal - s, 7) gop, CAST(candidate AS BIGINT) candidate FROM sc JOIN nm USING (event) WHERE position >= 0
QUALIFY row_number() OVER (PARTITION BY event, position ORDER BY s DESC, CASE WHEN candidate = -1 THEN 9999 ELSE candidate END) = 1""")
def variant_marginal(spark, sf_dir):
    other = lambda s: s % 63 + 1
    acc = F.transform("labels", lambda s, i: F.when((i == 0) & (F.col("event") % 2 == 0), F.array(s, other(s))).otherwise(F.array(s)))
    pos = targets(spark, sf_dir).select("event", acc.alias("accepted"))
    out = la.variant_marginal(matrices(spark, sf_dir), pos, "event", IDS).withColumn("gop", F.round("gop", 7))
    return out.withColumns({"position": F.col("position").cast("long"), "candidate": F.col("candidate").cast("long")})


SPANS_SQL = VITERBI_SQL + """,
sp AS (SELECT event, frame, (s - 1) // 2 AS position FROM (SELECT event, unnest(list_transform(string_split(p[e], ','), lambda x: CAST(x AS INT))) AS s,
  unnest(generate_series(0, len(string_split(p[e], ',')) - 1)) AS frame FROM en WHERE v[e] > -1e299) WHERE s % 2 = 1)"""


def label_frames(spark, sf_dir):
    return la.label_frames(paths(spark, sf_dir), "event")


@query("segment_spans", f"WITH RECURSIVE {SPANS_SQL} SELECT event, CAST(position AS BIGINT) position, CAST(min(frame) AS INT) start_frame, CAST(max(frame) + 1 AS INT) end_frame, count(*) n_frames FROM sp GROUP BY event, position")
def segment_spans(spark, sf_dir):
    return la.segment_spans(label_frames(spark, sf_dir), "event").withColumn("position", F.col("position").cast("long"))


@query("forced_score", f"""WITH RECURSIVE {SPANS_SQL},
m AS (SELECT sp.event, position, symbol, ln(avg(exp(logp))) lme, avg(logp) ml FROM sp JOIN lp ON lp.event = sp.event AND lp.frame = sp.frame WHERE symbol > 0 GROUP BY ALL),
x AS (SELECT m.*, symbol = labels[position + 1] own, row_number() OVER (PARTITION BY m.event, position, symbol = labels[position + 1] ORDER BY lme DESC, symbol) rn FROM m JOIN tg USING (event))
SELECT event, CAST(position AS BIGINT) position, round(max(lme) FILTER (WHERE own), 8) score, round(max(ml) FILTER (WHERE own), 8) self_score, CAST(max(symbol) FILTER (WHERE NOT own AND rn = 1) AS BIGINT) competitor,
 round(max(lme) FILTER (WHERE NOT own), 8) competitor_score, round(max(lme) FILTER (WHERE own) - max(lme) FILTER (WHERE NOT own), 8) margin FROM x GROUP BY event, position""")
def forced_score(spark, sf_dir):
    f = logp_frames(spark, sf_dir)
    long = f.select("event", "frame", F.posexplode("logp").alias("symbol", "logp")).where("symbol > 0")
    out = la.forced_score(label_frames(spark, sf_dir), long, targets(spark, sf_dir), "event")
    out = out.withColumns({"position": F.col("position").cast("long"), "competitor": F.col("competitor").cast("long")})
    return rounded(out, "score", "self_score", "competitor_score", "margin")
