"""Registered queries: joins, coverage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import inventory as inv
from strophe.functions import texts as tx
from strophe.operators import audits as au
from strophe.operators import detection as det
from strophe.operators import linking as lk
from strophe.plans.q_detection import CURVE, GAPS_SQL, gap_labels
from strophe.plans.q_text import WORDS, documents
from strophe.plans.registry import query, rounded
from strophe.plans.tables import METHODS, SCORED_ALL_SQL, SCORED_SQL, SYMBOLS, TOKENS_SQL, frames, scored, table, tokens, with_methods


@query("join_gold", f"""WITH {SCORED_SQL} SELECT method, grp, gold_event, count(*) n, round(avg(p_error), 8) mean_p,
  count(*) FILTER (WHERE stable_event) n_exact FROM scored GROUP BY ALL""")
def join_gold(spark, sf_dir):
    tok = tokens(spark, sf_dir)
    pred = with_methods(tok).select("method", "event", "idx", "grp", "p_error")
    out = lk.join_gold(pred, tok, ["event", "idx"]).groupBy("method", "grp", "gold_event").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_error").alias("mean_p"), F.count_if("stable_event").alias("n_exact"))
    return rounded(out, "mean_p")


def lexicon(spark, sf_dir):
    """Words of the benchmark texts; symbols are the letters, variant 2 is the reversed word."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.explode(F.array(F.lit(2), F.lit(1))).alias("variant")).withColumn(
        "symbols", F.split(F.when(F.col("variant") == 1, F.col("word")).otherwise(F.reverse("word")), ""))


@query("lexicon_lookup", f"""WITH lex AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark),
t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE lex.word IS NULL) AS n_oov, CAST(coalesce(sum(length(lex.word)), 0) AS BIGINT) AS n_symbols,
 count(*) FILTER (WHERE lex.word IS NULL) = 0 AS diagnostic FROM t LEFT JOIN lex USING (word) GROUP BY doc_id""")
def lexicon_lookup(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.explode(tx.words(F.col("text"))).alias("word"))
    found = lk.lexicon_lookup(words, lexicon(spark, sf_dir))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if("oov").alias("n_oov"),
        F.coalesce(F.sum(F.size("symbols").cast("long")), F.lit(0)).alias("n_symbols"), (F.count_if("oov") == 0).alias("diagnostic"))


@query("dedupe_then_map", f"""SELECT doc_id, md5(text) AS digest, CAST(len({WORDS}) AS BIGINT) AS n_words FROM documents""")
def dedupe_then_map(spark, sf_dir):
    mapper = lambda d: d.select("text", F.md5("text").alias("digest"), F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))
    return lk.map_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", mapper).drop("text")


@query("fallback_source", """WITH e AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, count(*) n, min(length(text)) v FROM conversations WHERE role = 'system' GROUP BY conv_id),
s AS (SELECT conv_id, count(*) n, min(length(text)) v FROM conversations WHERE role = 'user'  GROUP BY conv_id),
j AS (SELECT e.conv_id, p.n pn, p.v pv, s.n sn, s.v sv, p.n IS NULL AND e.conv_id % 3 <> 0 AS second FROM e LEFT JOIN p USING (conv_id) LEFT JOIN s USING (conv_id)),
k AS (SELECT *, coalesce(CASE WHEN second THEN sn ELSE pn END, 0) n FROM j)
SELECT conv_id, CASE WHEN n = 1 THEN CASE WHEN second THEN sv ELSE pv END END AS size, CASE WHEN n = 1 THEN CASE WHEN second THEN 'secondary' ELSE 'primary' END END AS origin,
 CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS reason FROM k""")
def fallback_source(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    return lk.fallback_source(c.select("conv_id").distinct(), c.where("role = 'system'"), c.where("role = 'user'"),
                              ["conv_id"], "size", F.col("conv_id") % 3 != 0)


@query("availability_inventory", """WITH k AS (SELECT n_nationkey AS grp, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT DISTINCT o_custkey % 25 AS grp, o_custkey AS k, o_orderstatus s, o_orderpriority p FROM orders),
m AS (SELECT grp, k, bool_or(TRUE) a, bool_or(p = '1-URGENT') b, bool_or(p = '5-LOW') c, bool_or(s = 'P') d FROM a GROUP BY ALL)
SELECT grp, count(*) n_a, count(*) FILTER (WHERE b) n_ab, count(*) FILTER (WHERE c) n_ac, count(*) FILTER (WHERE b OR c) n_abc,
 count(*) FILTER (WHERE d) n_ad FROM m GROUP BY grp""")
def availability_inventory(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey") % 25)
    return lk.availability(o, o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"),
                           o.where("o_orderstatus = 'P'"), "grp", "o_custkey")


SEGMENTS_SQL = TOKENS_SQL + """,
seg AS (SELECT event, idx, idx * 100 AS "start", (idx + 1) * 100 - CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS "end",
  CASE WHEN k % 11 = 0 THEN 'vcl' WHEN idx % 2 = 0 THEN ['b','d','g','k','p','t'][event % 6 + 1] || 'CL'
       WHEN k % 4 = 0 THEN target ELSE ['b','d','g','k','p','t'][event % 6 + 1] END AS label FROM tokens),
pairing AS (SELECT s.event, s.idx, lower(s.label) closure, lower(n.label) AS "following",
  coalesce(lower(s.label) = lower(n.label) || 'cl' AND length(lower(s.label)) = 3 AND lower(s.label) <> 'vcl' AND s."end" = n."start", FALSE) paired
  FROM seg s LEFT JOIN seg n ON n.event = s.event AND n.idx = s.idx + 1 WHERE lower(s.label) IN ('bcl','dcl','gcl','kcl','pcl','tcl','vcl'))"""


def segments(spark, sf_dir):
    t = tokens(spark, sf_dir)
    stop = F.element_at(F.array(*[F.lit(x) for x in "bdgkpt"]), (F.col("event") % 6 + 1).cast("int"))
    label = (F.when(F.col("k") % 11 == 0, "vcl").when(F.col("idx") % 2 == 0, F.concat(stop, F.lit("CL")))
             .when(F.col("k") % 4 == 0, F.col("target")).otherwise(stop))
    return t.select("event", "idx", (F.col("idx") * 100).alias("start"),
                    ((F.col("idx") + 1) * 100 - F.when(F.col("k") % 7 == 0, 5).otherwise(0)).alias("end"), label.alias("label"))


@query("adjacent_pairing", f"""WITH {SEGMENTS_SQL} SELECT event, idx, closure, "following", paired,
 CASE WHEN paired THEN 'paired_closure_release' ELSE 'unpaired_closure_requires_review' END AS status FROM pairing""")
def adjacent_pairing(spark, sf_dir):
    return lk.adjacent_pairing(segments(spark, sf_dir), ["event"], inv.CLOSURE_RELEASE, inv.OTHER_CLOSURES)


@query("quality_flags", f"""WITH {SEGMENTS_SQL},
ev AS (SELECT event, sum(k) stored FROM tokens GROUP BY event),
src AS (SELECT event, sum(k + CASE WHEN event % 31 = 0 THEN 1 ELSE 0 END) rec, event % 37 = 0 AS other FROM tokens WHERE event % 41 <> 0 GROUP BY event),
p AS (SELECT event, count(*) closures, count(*) FILTER (WHERE NOT paired) unpaired FROM pairing GROUP BY event)
SELECT ev.event, coalesce(closures, 0) closures, coalesce(unpaired, 0) unpaired, CASE WHEN src.event IS NULL OR other OR rec <> stored THEN 'source_integrity_failure'
 WHEN coalesce(unpaired, 0) > 0 THEN 'unpaired_or_nonmatching_closure_release' END AS quality
FROM ev LEFT JOIN src USING (event) LEFT JOIN p USING (event)""")
def quality_flags(spark, sf_dir):
    t = tokens(spark, sf_dir)
    stem = F.concat(F.lit("E"), F.col("event").cast("string"))
    events = t.groupBy("event").agg(F.sum("k").alias("stored")).withColumn("stem", stem)
    sources = t.where("event % 41 <> 0").groupBy("event").agg(
        F.sum(F.col("k") + F.when(F.col("event") % 31 == 0, 1).otherwise(0)).alias("recomputed")
    ).withColumn("stem_seen", F.when(F.col("event") % 37 == 0, "other").otherwise(F.lower(stem)))
    return au.quality_flags(events, sources, adjacent_pairing(spark, sf_dir), ["event"])


@query("crossfit_join", f"""WITH {TOKENS_SQL},
c AS (SELECT grp, target AS source, realized AS alternative, count(*) n FROM tokens WHERE gold_event = 'substitution' GROUP BY ALL),
g AS (SELECT DISTINCT grp FROM tokens), r AS (SELECT t.grp AS test, o.grp FROM g t, g o WHERE o.grp <> t.grp AND o.grp <> 'g11'),
x AS (SELECT test, md5(string_agg(grp, ',' ORDER BY grp)) AS context, count(*) ng FROM r GROUP BY test),
m AS (SELECT DISTINCT context, r.grp, ng FROM r JOIN x USING (test))
SELECT context, source, alternative, CAST(sum(n) AS BIGINT) n, max(ng) n_groups FROM m JOIN c USING (grp) GROUP BY ALL""")
def crossfit_join(spark, sf_dir):
    """Confusion totals per training context; the always-excluded group shares one context."""
    t = tokens(spark, sf_dir)
    counts = t.where("gold_event = 'substitution'").groupBy("grp", F.col("target").alias("source"), F.col("realized").alias("alternative")).agg(
        F.count(F.lit(1)).alias("n"))
    groups = t.select("grp").distinct()
    roles = groups.select(F.col("grp").alias("test")).join(groups, (F.col("test") != F.col("grp")) & (F.col("grp") != "g11"))
    return lk.crossfit(counts, roles, "test", "grp", ["source", "alternative"], ["n"])


@query("coverage_equal", f"""WITH {SCORED_ALL_SQL},
have AS (SELECT method, key FROM scored_all WHERE NOT (method = 'beta' AND key % 97 = 0) AND NOT (key % 89 = 5)
  UNION ALL SELECT 'gamma', key + 10000000 FROM scored_all WHERE method = 'gamma' AND key % 83 = 0),
expected AS (SELECT key FROM tokens)
SELECT key, method, 'missing' AS problem FROM (SELECT m AS method, key FROM expected, (VALUES ('alpha'), ('beta'), ('gamma')) x(m) EXCEPT SELECT method, key FROM have)
UNION ALL SELECT key, method, 'extra' FROM (SELECT method, key FROM have WHERE key NOT IN (SELECT key FROM expected))""")
def coverage_equal(spark, sf_dir):
    tok = tokens(spark, sf_dir)
    p = with_methods(tok).select("method", "key")
    have = p.where("NOT (method = 'beta' AND key % 97 = 0) AND NOT (key % 89 = 5)").unionByName(
        p.where("method = 'gamma' AND key % 83 = 0").withColumn("key", F.col("key") + 10000000))
    return lk.coverage_gaps(have, tok, "method", ["key"], METHODS)


@query("matched_subset", f"""WITH {SCORED_SQL},
r AS (SELECT method, key, score FROM scored WHERE NOT (method = 'alpha' AND key % 5 = 0) AND NOT (method = 'gamma' AND key % 91 = 1)),
b AS (SELECT DISTINCT key FROM r WHERE method = 'alpha')
SELECT method, count(*) n, round(avg(score), 8) mean_score, (SELECT count(*) FROM b) n_reference, count(*) = (SELECT count(*) FROM b) complete
FROM r WHERE key IN (SELECT key FROM b) GROUP BY method""")
def matched_subset(spark, sf_dir):
    r = scored(spark, sf_dir).select("method", "key", "score").where(
        "NOT (method = 'alpha' AND key % 5 = 0) AND NOT (method = 'gamma' AND key % 91 = 1)")
    return rounded(lk.matched_subset(r, "method", ["key"], "alpha"), "mean_score")


@query("claim_diff", f"""WITH {SCORED_SQL},
o AS (SELECT method, grp, avg(p_error) v FROM scored GROUP BY ALL),
c AS (SELECT method, grp, CASE WHEN grp = 'g03' THEN v + 0.001 ELSE v END v FROM o WHERE grp <> 'g05' UNION ALL SELECT 'delta', 'g01', 0.5::DOUBLE)
SELECT method, grp, round(c.v, 8) claimed, round(o.v, 8) observed, CASE WHEN c.v IS NULL THEN 'not_claimed' WHEN o.v IS NULL THEN 'not_observed' ELSE 'differs' END status
FROM c FULL JOIN o USING (method, grp) WHERE c.v IS NULL OR o.v IS NULL OR grp = 'g03'""")
def claim_diff(spark, sf_dir):
    observed = scored(spark, sf_dir).groupBy("method", "grp").agg(F.avg("p_error").alias("v"))
    claimed = observed.where("grp <> 'g05'").withColumn("v", F.when(F.col("grp") == "g03", F.col("v") + 0.001).otherwise(F.col("v")))
    stray = spark.createDataFrame([("delta", "g01", 0.5)], "method string, grp string, v double")
    return rounded(lk.claim_diff(claimed.unionByName(stray), observed, ["method", "grp"], "v"), "claimed", "observed")


@query("paired_difference", f"""WITH {SCORED_SQL}, {CURVE},
p AS (SELECT * FROM (VALUES ('alpha', 'beta'), ('alpha', 'gamma'), ('gamma', 'beta')) x(a, b))
SELECT a, b, count(*) n_groups, round(avg(x.ap - y.ap), 8) + 0.0 AS difference, count(*) FILTER (WHERE x.ap > y.ap) n_improved
FROM p JOIN rank_metrics x ON x.method = a JOIN rank_metrics y ON y.method = b AND y.grp = x.grp WHERE x.ap IS NOT NULL AND y.ap IS NOT NULL GROUP BY ALL""")
def paired_difference(spark, sf_dir):
    m = det.ranking_metrics(scored(spark, sf_dir), ["method", "grp"], "score", "gold_error")
    pairs = spark.createDataFrame([("alpha", "beta"), ("alpha", "gamma"), ("gamma", "beta")], "a string, b string")
    return rounded(lk.paired_difference(m, pairs, "grp", "ap"), "difference")


@query("pair_sample", f"""WITH {TOKENS_SQL},
p AS (SELECT grp, key, row_number() OVER (PARTITION BY grp ORDER BY key) r FROM tokens WHERE gold_error = 1),
n AS (SELECT grp, key, row_number() OVER (PARTITION BY grp ORDER BY key) r FROM tokens WHERE gold_error = 0),
s AS (SELECT grp, count(*) FILTER (WHERE gold_error = 1) np, count(*) FILTER (WHERE gold_error = 0) nn FROM tokens GROUP BY grp),
t AS (SELECT *, least(512, np * nn) m, count(*) OVER () g FROM s WHERE np > 0 AND nn > 0),
d AS (SELECT *, unnest(generate_series(0, m - 1)) draw FROM t),
e AS (SELECT *, draw * (np * nn // m) + least(draw, np * nn % m) + ('0x' || substr(md5(grp || '-' || draw), 1, 15))::BIGINT % (np * nn // m + CAST(draw < np * nn % m AS BIGINT)) i FROM d)
SELECT e.grp, draw, p.key AS positive, n.key AS negative, round(1.0::DOUBLE / g / m, 10) weight FROM e
 JOIN p ON p.grp = e.grp AND p.r = e.i // nn + 1 JOIN n ON n.grp = e.grp AND n.r = e.i % nn + 1""")
def pair_sample(spark, sf_dir):
    t = tokens(spark, sf_dir).select("grp", "key", "gold_error")
    return lk.pair_sample(t, "grp", "key", "gold_error").withColumn("weight", F.round("weight", 10))


@query("role_disjoint", f"""WITH {TOKENS_SQL}, g AS (SELECT DISTINCT grp FROM tokens),
r AS (SELECT 'f' || (CAST(substr(grp, 2) AS INT) % 3) AS fold, grp, 'test' AS role FROM g UNION ALL SELECT 'f' || f, grp, 'train' FROM g, (VALUES (0), (1), (2)) x(f)
  WHERE CAST(substr(grp, 2) AS INT) % 3 <> f OR grp = 'g04'),
ov AS (SELECT fold, grp FROM r GROUP BY ALL HAVING count(DISTINCT role) > 1)
SELECT fold, grp, 'overlap' AS problem FROM ov
UNION ALL SELECT 'f' || (key % 4), grp, 'undeclared' FROM tokens WHERE key % 4 = 3 GROUP BY ALL""")
def role_disjoint(spark, sf_dir):
    t = tokens(spark, sf_dir)
    g = t.select("grp", F.substring("grp", 2, 2).cast("int").alias("n")).distinct()
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    test = g.select(name(F.col("n") % 3).alias("fold"), "grp", F.lit("test").alias("role"))
    train = g.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("f")).where((F.col("n") % 3 != F.col("f")) | (F.col("grp") == "g04"))
    roles = test.unionByName(train.select(name(F.col("f")).alias("fold"), "grp", F.lit("train").alias("role")))
    rows = t.select(name(F.col("key") % 4).alias("fold"), "grp")
    over = lk.role_overlaps(roles, "fold", "grp", "role").select("fold", "grp", F.lit("overlap").alias("problem"))
    return over.unionByName(lk.undeclared_groups(rows, roles, "fold", "grp"))


@query("prior_join", f"""WITH {TOKENS_SQL},
pr AS (SELECT grp AS context, target AS source, avg(gold_error) rate FROM tokens GROUP BY ALL)
SELECT key, round(rate, 8) rate FROM tokens t JOIN pr ON pr.context = t.grp AND pr.source = t.target""")
def prior_join(spark, sf_dir):
    t = tokens(spark, sf_dir)
    prior = t.groupBy("grp", "target").agg(F.avg("gold_error").alias("rate"))
    return rounded(t.join(prior, ["grp", "target"]).select("key", "rate"), "rate")


@query("dense_domain", f"""WITH {TOKENS_SQL}, s AS (SELECT unnest(['click','error','purchase','signup','view']) x),
d AS (SELECT a.x AS source, b.x AS alternative FROM s a, s b WHERE a.x <> b.x UNION ALL SELECT x, '<DEL>' FROM s),
c AS (SELECT target AS source, CASE WHEN gold_event = 'deletion' THEN '<DEL>' ELSE realized END AS alternative, count(*) n FROM tokens WHERE gold_error = 1 GROUP BY ALL)
SELECT source, alternative, coalesce(n, 0) n FROM d LEFT JOIN c USING (source, alternative)""")
def dense_domain(spark, sf_dir):
    from strophe.operators.priors import dense_counts
    t = tokens(spark, sf_dir).where("gold_error = 1").select(
        F.col("target").alias("source"), F.coalesce("realized", F.lit(inv.DELETE)).alias("alternative"))
    return dense_counts(t.groupBy("source", "alternative").agg(F.count(F.lit(1)).alias("n")), SYMBOLS)


@query("coverage_counts", f"""WITH {TOKENS_SQL}
SELECT grp, count(DISTINCT event) events, count(DISTINCT event) FILTER (WHERE quality IS NULL) usable_events, count(*) positions,
 count(*) FILTER (WHERE quality IS NULL AND diagnostic AND stable_error) detection_positions,
 count(*) FILTER (WHERE quality IS NULL AND diagnostic AND stable_event) exact_positions,
 count(*) FILTER (WHERE quality IS NULL AND diagnostic AND stable_error AND gold_error = 1) errors,
 count(*) FILTER (WHERE quality IS NULL AND k % 6 = 0) variant_positions FROM tokens GROUP BY grp""")
def coverage_counts(spark, sf_dir):
    return au.coverage_counts(tokens(spark, sf_dir), ["grp"], F.col("k") % 6 == 0)


@query("manifest_audit", f"""WITH {TOKENS_SQL},
e AS (SELECT event, max(cohort) cohort, count(*) n, count(*) FILTER (WHERE stable_event) s, string_agg(target, ' ' ORDER BY idx) seq,
  string_agg(CAST(k // 25 AS VARCHAR), '' ORDER BY idx) txt FROM tokens GROUP BY event)
SELECT CAST(sum(n) AS BIGINT) positions, CAST(sum(s) AS BIGINT) stable_positions, count(*) events, count(DISTINCT txt) distinct_texts, count(DISTINCT seq) distinct_sequences,
 CAST(sum(n) FILTER (WHERE cohort = 'case') AS BIGINT) case_positions, CAST(sum(s) FILTER (WHERE cohort = 'case') AS BIGINT) case_stable,
 round(sum(s) / sum(n)::DOUBLE, 8) stable_fraction, round(sum(s) FILTER (WHERE cohort = 'case') / sum(n) FILTER (WHERE cohort = 'case')::DOUBLE, 8) case_stable_fraction,
 sum(s) FILTER (WHERE cohort = 'case') / sum(n) FILTER (WHERE cohort = 'case')::DOUBLE >= 0.8 eligible FROM e""")
def manifest_audit(spark, sf_dir):
    e = tokens(spark, sf_dir).groupBy("event").agg(
        F.max("cohort").alias("cohort"), F.count(F.lit(1)).alias("n_positions"), F.count_if("stable_event").alias("n_stable"),
        F.array_sort(F.collect_list(F.struct("idx", "target", (F.col("k") / 25).cast("int").alias("c")))).alias("_s"))
    e = e.withColumns({"seq": F.concat_ws(" ", F.transform("_s", lambda x: x["target"])),
                       "txt": F.concat_ws("", F.transform("_s", lambda x: x["c"].cast("string")))})
    return rounded(au.manifest_audit(e, "txt", "seq"), "stable_fraction", "case_stable_fraction")


@query("exclusion_report", """WITH r AS (SELECT c_mktsegment grp, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'short' END reason
 FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT grp, count(*) FILTER (WHERE reason IS NULL) kept, count(reason) excluded, count(*) FILTER (WHERE reason = 'pending') excluded_pending,
 count(*) FILTER (WHERE reason = 'short') excluded_short, round(count(*) FILTER (WHERE reason IS NULL) / count(*)::DOUBLE, 8) coverage FROM r GROUP BY grp""")
def exclusion_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("grp"),
                 F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 50000, "short").alias("reason"))
    return rounded(au.exclusion_report(o.where("reason IS NULL"), o.where("reason IS NOT NULL"), "grp", ["pending", "short"]), "coverage")


@query("symbol_counts", f"""WITH w AS (SELECT unnest({WORDS}) word FROM documents), l AS (SELECT unnest(string_split(word, '')) ch FROM w), c AS (SELECT ch, count(*) n FROM l GROUP BY ALL),
u AS (SELECT upper(ch) sym, sum(n) n FROM c GROUP BY ALL), i AS (SELECT unnest(['AA','AE','AH','AO','AW','AY','B','CH','D','DH','EH','ER','EY','F','G','HH','IH','IY','JH','K','L','M','N','NG','OW','OY','P','R','S','SH','T','TH','UH','UW','V','W','Y','Z','ZH']) phone)
SELECT phone, CAST(coalesce(n, 0) AS BIGINT) n FROM i LEFT JOIN u ON sym = phone""")
def symbol_counts(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("word"))
    # Distinct words first: letters are exploded once per word, weighted by its count.
    per = w.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    letters = per.select("c", F.explode(F.split(F.upper("word"), "")).alias("phone")).groupBy("phone").agg(F.sum("c").alias("n"))
    return inv.phone_table(spark).select("phone").join(letters, "phone", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("confusion_counts", f"""WITH {TOKENS_SQL} SELECT grp, target AS source, CASE gold_event WHEN 'match' THEN 'OK' WHEN 'substitution' THEN 'SUB' ELSE 'DEL' END op,
 CASE gold_event WHEN 'deletion' THEN '<DEL>' ELSE realized END alternative, count(*) n FROM tokens WHERE quality IS NULL AND diagnostic AND stable_event GROUP BY ALL""")
def confusion_counts(spark, sf_dir):
    return au.confusion_counts(tokens(spark, sf_dir), ["grp"])


@query("gap_length_counts", f"""WITH {GAPS_SQL},
g AS (SELECT gaps.grp, CASE WHEN tokens.quality IS NOT NULL THEN 'quality_excluded' WHEN NOT gaps.diagnostic THEN 'nondiagnostic' WHEN NOT stable THEN 'alignment_uncertain'
  ELSE 'stable_length_' || n_ins END status, n_ins FROM gaps JOIN tokens USING (event, idx))
SELECT grp, status, count(*) gaps, CAST(sum(CASE WHEN status LIKE 'stable%' THEN n_ins ELSE 0 END) AS BIGINT) inserted_symbols,
 count(*) FILTER (WHERE status LIKE 'stable%' AND n_ins > 2) over_cap, CAST(sum(CASE WHEN status LIKE 'stable%' THEN greatest(n_ins - 2, 0) ELSE 0 END) AS BIGINT) over_cap_extra FROM g GROUP BY ALL""")
def gap_length_counts(spark, sf_dir):
    quality = F.when(F.col("event") % 23 == 0, "review")
    return au.gap_length_counts(gap_labels(spark, sf_dir).withColumn("quality", quality), ["grp"])


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _fingerprint_sql(cols):
    """Every column of the table; a null and any text differ by their first character."""
    text = {"o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')"}
    cells = ", ".join(f"coalesce('v' || {text.get(c, f'CAST({c} AS VARCHAR)')}, 'n')" for c in cols)
    return f"""WITH d AS (SELECT md5(concat_ws(chr(31), {cells})) m FROM orders),
n AS (SELECT ('0x' || substr(m, 1, 15))::BIGINT h, ('0x' || substr(m, 16, 15))::BIGINT l FROM d),
s AS (SELECT count(*) n_rows, sum(h) sh, bit_xor(h) xh, sum(l) sl, bit_xor(l) xl FROM n)
SELECT n_rows, md5(concat_ws('|', CAST(n_rows AS VARCHAR), CAST(sh AS VARCHAR), CAST(xh AS VARCHAR), CAST(sl AS VARCHAR), CAST(xl AS VARCHAR))) fingerprint FROM s"""


@query("table_fingerprint", _fingerprint_sql(ORDER_COLUMNS))
def table_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    assert set(o.columns) == set(ORDER_COLUMNS), o.columns
    o = o.withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")})
    return au.table_fingerprint(o, list(ORDER_COLUMNS))


@query("group_summary", f"""WITH {TOKENS_SQL},
p AS (SELECT event, target, idx, 'w' || (k % 4) word, diagnostic AS assessed, gold_error = 1 flagged FROM tokens)
SELECT event, target, count(*) FILTER (WHERE assessed AND flagged) flagged, count(*) FILTER (WHERE assessed) assessed, count(*) FILTER (WHERE NOT assessed) unassessed,
 coalesce(string_agg(word, ', ' ORDER BY idx) FILTER (WHERE assessed AND flagged), '') flagged_words FROM p GROUP BY ALL""")
def group_summary(spark, sf_dir):
    p = tokens(spark, sf_dir).select("event", "target", "idx", F.concat(F.lit("w"), (F.col("k") % 4).cast("string")).alias("word"),
                                     F.col("diagnostic").alias("assessed"), (F.col("gold_error") == 1).alias("flagged"))
    return au.group_summary(p, ["event", "target"], "idx").withColumn("flagged_words", F.concat_ws(", ", "flagged_words"))


@query("quantile_summary", """WITH q AS (SELECT l_returnflag grp, unnest([0, 0.25, 0.5, 0.75, 0.95, 1]::DOUBLE[]) prob,
 unnest(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 0.95, 1])) AS value FROM lineitem GROUP BY l_returnflag)
SELECT grp, prob, round(value, 6) AS value FROM q""")
def quantile_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    out = au.exact_quantiles(li, ["grp"], "l_extendedprice", [0, 0.25, 0.5, 0.75, 0.95, 1])
    return out.withColumn("value", F.round("value", 6))


@query("check_pass_rates", f"""WITH {TOKENS_SQL},
c AS (SELECT cohort, key, stable_event AND diagnostic success, unnest([{{'n': 'stable', 'ok': stable_event}}, {{'n': 'diagnostic', 'ok': diagnostic}}, {{'n': 'realized', 'ok': CASE WHEN gold_event <> 'deletion' THEN realized = target END}}]) u FROM tokens)
SELECT cohort, u.n AS "check", count(*) FILTER (WHERE u.ok) passed, count(*) n FROM c WHERE u.ok IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'pairs', 'both_correct', count(*) FILTER (WHERE a.stable_event AND a.diagnostic AND b.stable_event AND b.diagnostic), count(*) FROM tokens a JOIN tokens b ON b.key = a.key - 1 WHERE a.key % 2 = 1""")
def check_pass_rates(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumns({
        "stable": F.col("stable_event"), "success": F.col("stable_event") & F.col("diagnostic"),
        "partner": F.when(F.col("key") % 2 == 1, F.col("key") - 1),
        "realized": F.when(F.col("gold_event") != "deletion", F.col("realized") == F.col("target"))})
    rates = au.check_pass_rates(t, ["cohort"], ["stable", "diagnostic", "realized"])
    both = au.paired_both_correct(t, "key", "partner", "success")
    return rates.unionByName(both.select(F.lit("pairs").alias("cohort"), F.lit("both_correct").alias("check"),
                                         F.col("both_correct").alias("passed"), F.col("n_pairs").alias("n")))


@query("methods_union", f"""WITH {SCORED_SQL},
u AS (SELECT method, key, gop AS v FROM scored WHERE method <> 'beta' UNION ALL SELECT 'beta', key, -(p_error * 10) FROM scored WHERE method = 'beta')
SELECT method, count(*) n, round(avg(v), 8) mean_gop FROM u GROUP BY method""")
def methods_union(spark, sf_dir):
    """Replace one method's rows by a new source whose score column has another name and sign."""
    s = scored(spark, sf_dir)
    old = s.select("method", "key", "gop")
    new = s.where("method = 'beta'").select("method", "key", (F.col("p_error") * 10).alias("error_evidence"))
    from strophe.operators.selection import replace_methods
    out = replace_methods(old, new.select("method", "key", (-F.col("error_evidence")).alias("gop")), "method")
    return rounded(out.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("gop").alias("mean_gop")), "mean_gop")


@query("backoff_join", f"""WITH {TOKENS_SQL},
p AS (SELECT target, avg(k) v FROM tokens WHERE gold_error = 1 GROUP BY target HAVING count(*) >= 20),
g AS (SELECT avg(k) v FROM tokens WHERE gold_error = 1)
SELECT t.target, count(*) n, round(max(coalesce(p.v, g.v)), 8) penalty, bool_or(p.v IS NULL) fallback FROM tokens t LEFT JOIN p USING (target), g GROUP BY t.target""")
def backoff_join(spark, sf_dir):
    from strophe.operators.selection import with_backoff
    t = tokens(spark, sf_dir)
    src = t.where("gold_error = 1")
    specific = src.groupBy("target").agg(F.avg("k").alias("v"), F.count(F.lit(1)).alias("c")).where("c >= 20").select("target", "v")
    out = with_backoff(t.select("target"), specific, src.agg(F.avg("k").alias("v")), ["target"], "v", "penalty")
    return rounded(out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max("penalty").alias("penalty"), F.bool_or("fallback").alias("fallback")), "penalty")


# --- structural checks of the inputs --------------------------------------------------------------

@query("unequal_lengths", f"""WITH {TOKENS_SQL}, s AS (SELECT event, count(*) n FROM tokens GROUP BY event)
SELECT event, CAST(n AS INT) n_symbols, CAST(n - 1 AS INT) n_mask FROM s WHERE event % 11 = 0""")
def unequal_lengths(spark, sf_dir):
    """Recordings whose arrays differ in length; every eleventh one lost the last mark."""
    from strophe.operators.contracts import unequal_lengths as check
    rows = F.array_sort(F.collect_list(F.struct("idx", "target", "diagnostic")))
    e = tokens(spark, sf_dir).groupBy("event").agg(F.transform(rows, lambda r: r["target"]).alias("symbols"), F.transform(rows, lambda r: r["diagnostic"]).alias("mask"))
    return check(e.withColumn("mask", F.when(F.col("event") % 11 == 0, F.slice("mask", F.lit(1), F.size("mask") - 1)).otherwise(F.col("mask"))), ["event"], ["symbols", "mask"])


@query("inconsistent_metadata", """SELECT o_custkey, field FROM (SELECT o_custkey, min(o_orderstatus) <> max(o_orderstatus) a, min(o_orderpriority) <> max(o_orderpriority) b FROM orders GROUP BY o_custkey),
 (VALUES ('o_orderstatus'), ('o_orderpriority')) f(field) WHERE CASE field WHEN 'o_orderstatus' THEN a ELSE b END""")
def inconsistent_metadata(spark, sf_dir):
    from strophe.operators.association import inconsistent_metadata as check
    return check(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("duplicate_frames", "SELECT vec_id // 10 AS event, vec_id % 10 AS frame, CAST(2 AS BIGINT) n FROM embeddings WHERE (vec_id // 10) % 5 = 0 AND vec_id % 3 = 0")
def duplicate_frames(spark, sf_dir):
    """Frames stored twice; some frames of every fifth recording are."""
    from strophe.sources.frames import duplicate_frames as check
    f = frames(spark, sf_dir)
    again = f.where((F.col("event") % 5 == 0) & ((F.col("event") * 10 + F.col("frame")) % 3 == 0))
    return check(f.select("event", "frame").unionByName(again.select("event", "frame")))
