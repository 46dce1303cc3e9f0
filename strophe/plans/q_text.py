"""Registered queries: text predicates, keys, row contracts and runtime records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import inventory as inv
from strophe.functions import texts as tx
from strophe.operators import contracts as ct
from strophe.plans.registry import query, rounded
from strophe.plans.tables import SCORED_SQL, SYMBOLS, TOKENS_SQL, scored, table, tokens

SQL_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NORM = f"trim(regexp_replace(coalesce(text, ''), '{SQL_SPACES}', ' ', 'g'))"
WORDS = r"regexp_extract_all(lower(replace(text, '’', '''')), '[a-z0-9]+(?:[''.-][a-z0-9]+)*')"


def documents(spark, sf_dir):
    """Document texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@query("text_normalize", f"SELECT doc_id, {NORM} AS normalized, length({NORM}) AS n_chars FROM documents")
def text_normalize(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))
    return d.withColumn("n_chars", F.length("normalized").cast("long"))


@query("text_validate", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents
  UNION ALL SELECT -page_id - 1, url FROM pages),
n AS (SELECT doc_id, {NORM} AS t FROM lines),
r AS (SELECT doc_id, CASE WHEN lower(t) IN ('', 'xxx', 'noise', 'silence') THEN 'empty_or_noise' WHEN starts_with(t, '[') THEN 'elicitation_instruction'
  WHEN contains(lower(t), '.jpg') OR contains(lower(t), '.jpeg') OR contains(lower(t), '.png') THEN 'picture_prompt'
  WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'no_english_letters' END AS reason FROM n)
SELECT doc_id, reason, reason IS NULL AS valid, count(*) AS n FROM r GROUP BY ALL""")
def text_validate(spark, sf_dir):
    """Every line of every document, and every page address, as a candidate prompt."""
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    urls = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("url").alias("text"))
    out = lines.unionByName(urls).select("doc_id", tx.text_reason(F.col("text")).alias("reason"))
    return out.groupBy("doc_id", "reason", F.col("reason").isNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("text_char_audit", rf"""WITH a AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{SQL_CONTROLS}'))) c,
  list_sort(list_distinct(regexp_extract_all(text, '[^\x00-\x7f]'))) f FROM documents)
SELECT doc_id, len(c) AS n_controls, len(f) AS n_foreign, array_to_string(f, ' ') AS offenders FROM a WHERE len(c) + len(f) > 0""")
def text_char_audit(spark, sf_dir):
    d = documents(spark, sf_dir).select(
        "doc_id", tx.control_chars(F.col("text")).alias("c"), tx.non_ascii_chars(F.col("text")).alias("f"))
    return d.where(F.size("c") + F.size("f") > 0).select(
        "doc_id", F.size("c").cast("long").alias("n_controls"), F.size("f").cast("long").alias("n_foreign"),
        F.concat_ws(" ", "f").alias("offenders"))


@query("live_text_guard", rf"""WITH t AS (SELECT conv_id, turn, len({WORDS}) AS positions, text,
  regexp_replace(regexp_replace(text, '^{SQL_SPACES}', ''), '{SQL_SPACES}$', '') AS s FROM conversations)
SELECT conv_id, turn, CAST(positions AS BIGINT) positions, CASE WHEN s = '' OR length(s) > 500 THEN 'length'
  WHEN regexp_matches(regexp_replace(s, '[\x00-\x7f]', '', 'g'), '[\p{{L}}\p{{N}}]') THEN 'non_ascii_letters'
  WHEN regexp_matches(s, '{SQL_CONTROLS}') THEN 'control_characters' WHEN positions > 80 THEN 'too_many_positions' END AS reason FROM t""")
def live_text_guard(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("positions", F.size(tx.words(F.col("text"))).cast("long"))
    return d.select("conv_id", "turn", "positions", tx.live_text_reason(F.col("text"), F.col("positions")).alias("reason"))


@query("tokenize_words", f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM t)
SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, min(word) AS first_sorted, max(word) AS last_sorted,
  CAST(sum(pos * length(word)) AS BIGINT) AS position_weight FROM u GROUP BY doc_id""")
def tokenize_words(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    return tx.word_counts(d, "doc_id", "w")


@query("symbol_normalize", f"""WITH {TOKENS_SQL},
r AS (SELECT key, CASE WHEN k % 9 = 0 THEN 'sil' WHEN k % 9 = 1 THEN ' TCL' WHEN k % 9 = 2 THEN 'ax-h' WHEN k % 9 = 3 THEN 'EN1'
   WHEN k % 9 = 4 THEN 'dx' WHEN k % 9 = 5 THEN 'AH' || (k % 3) WHEN k % 9 = 6 THEN 'iy ' ELSE target END AS label FROM tokens),
s AS (SELECT key, label, regexp_replace(lower(trim(label)), '[0-9]+$', '') AS raw FROM r)
SELECT label, CASE raw WHEN 'ax-h' THEN 'AH' WHEN 'en' THEN 'N' WHEN 'dx' THEN 'T' WHEN 'ah' THEN 'AH' WHEN 'iy' THEN 'IY' END AS symbol,
  CASE WHEN raw IN ('sil', 'tcl') THEN 'dropped' WHEN raw IN ('ax-h', 'en', 'dx', 'ah', 'iy') THEN 'ok' ELSE 'unknown' END AS status,
  count(*) AS n FROM s GROUP BY ALL""")
def symbol_normalize(spark, sf_dir):
    m = F.col("k") % 9
    label = (F.when(m == 0, "sil").when(m == 1, " TCL").when(m == 2, "ax-h").when(m == 3, "EN1").when(m == 4, "dx")
             .when(m == 5, F.concat(F.lit("AH"), (F.col("k") % 3).cast("string"))).when(m == 6, "iy ").otherwise(F.col("target")))
    d = tokens(spark, sf_dir).select(label.alias("label"))
    known = [*inv.PHONES, "AX", "DX"]
    d = d.withColumn("n_", tx.normalize_symbol(F.col("label"), inv.DROPPED_LABELS, inv.ALLOPHONES, known))
    # The intermediate symbols are folded after the inventory check.
    folded = F.coalesce(F.element_at(inv.literal_map(inv.PROJECTION), F.col("n_.symbol")), F.col("n_.symbol"))
    return d.groupBy("label", folded.alias("symbol"), F.col("n_.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("symbol_sequence_map", f"""WITH w AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
c AS (SELECT item_id, pos, word, unnest(string_split(word, '')) AS ch FROM
   (SELECT item_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w)),
m AS (SELECT *, CASE WHEN ch IN ('b','d','f','g','k','l','m','n','p','r','s','t','v','w','y','z') THEN upper(ch) WHEN ch = 'e' THEN 'EH'
   WHEN ch = 'h' THEN 'HH' WHEN ch = 'i' THEN 'IY' WHEN ch = 'j' THEN 'Y' WHEN ch = 'u' THEN 'UW' END AS sym FROM c)
SELECT item_id, count(sym) AS n_symbols, count(*) - count(sym) AS n_unknown, count(*) FILTER (WHERE sym IN ('EH','IY','UW')) AS n_vowels
FROM m GROUP BY item_id""")
def symbol_sequence_map(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("word"))
    d = d.withColumn("m", tx.map_ipa_tokens(F.split("word", "")))
    vowels = F.filter("m.symbols", lambda s: s.isin(list(inv.VOWELS)))
    return d.groupBy("item_id").agg(
        F.sum(F.size("m.symbols").cast("long")).alias("n_symbols"), F.sum(F.size("m.unknown").cast("long")).alias("n_unknown"),
        F.sum(F.size(vowels).cast("long")).alias("n_vowels"))


@query("event_key", r"""WITH u AS (SELECT page_id, 'M' || lpad(CAST(page_id % 7 AS VARCHAR), 2, '0') AS g,
   regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, CASE WHEN page_id % 11 = 0 THEN ' ' WHEN page_id % 13 = 0 THEN 'a|b' ELSE CAST(page_id AS VARCHAR) END AS stem FROM pages)
SELECT page_id, CASE WHEN trim(stem) <> '' AND NOT contains(stem, '|') AND host <> '' THEN g || '|' || host || '|' || stem END AS event_key,
   CASE WHEN trim(stem) <> '' AND NOT contains(stem, '|') AND host <> '' THEN host END AS session, 'M' AS prefix FROM u""")
def event_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("M"), F.lpad((F.col("page_id") % 7).cast("string"), 2, "0")).alias("g"),
        F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"),
        F.when(F.col("page_id") % 11 == 0, " ").when(F.col("page_id") % 13 == 0, "a|b").otherwise(F.col("page_id").cast("string")).alias("stem"))
    p = p.withColumn("event_key", tx.event_key(F.col("g"), F.col("host"), F.col("stem")))
    _, session, _ = tx.split_event_key(F.col("event_key"), ["g_", "session", "stem_"])
    return p.select("page_id", "event_key", session, tx.group_prefix(F.col("g")).alias("prefix"))


@query("grade_score", """WITH o AS (SELECT o_orderkey, chr(CAST(97 + o_custkey % 7 AS INT)) || CASE o_orderstatus WHEN 'F' THEN '/' || chr(CAST(65 + o_orderkey % 6 AS INT))
   WHEN 'P' THEN chr(92) || ' b ' ELSE '' END AS grade FROM orders),
p AS (SELECT o_orderkey, grade, unnest(string_split(replace(grade, chr(92), '/'), '/')) AS part FROM o),
s AS (SELECT o_orderkey, grade, CASE WHEN lower(trim(part)) IN ('a','b','c','d','e') THEN ascii(lower(trim(part))) - 96 END AS v FROM p)
SELECT o_orderkey, grade, round(avg(v), 8) AS score FROM s GROUP BY ALL""")
def grade_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tail = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/"), F.char(65 + F.col("o_orderkey") % 6)))
            .when(F.col("o_orderstatus") == "P", F.lit("\\ b ")).otherwise(""))
    o = o.select("o_orderkey", F.concat(F.char(97 + F.col("o_custkey") % 7), tail).alias("grade"))
    return rounded(o.withColumn("score", tx.grade_score(F.col("grade"))), "score")


@query("exclude_events", f"""WITH {TOKENS_SQL} SELECT grp, count(*) AS n, count(DISTINCT event) AS events FROM tokens
WHERE event NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY grp""")
def exclude_events(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event"))
    kept = tokens(spark, sf_dir).join(listed, "event", "left_anti")
    per = kept.groupBy("grp", "event").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("events"))


@query("project_whitelist", f"""WITH {SCORED_SQL} SELECT key, event, idx, target, round(gop, 8) gop, round(p_error, 8) p_error FROM scored
WHERE method = 'alpha'""")
def project_whitelist(spark, sf_dir):
    """Label-free runtime fields of one method; everything else is pruned from the scan."""
    out = scored(spark, sf_dir).where("method = 'alpha'").select("key", "event", "idx", "target", "gop", "p_error")
    return rounded(out, "gop", "p_error")


@query("leak_check", r"""WITH p AS (SELECT url, html FROM pages)
SELECT 'wav_path' AS field, 'raw_path' AS finding, count(*) AS n FROM p WHERE regexp_matches(url, '[A-Za-z]:[\\/]') HAVING count(*) > 0
UNION ALL SELECT 'body', 'raw_path', count(*) FROM p WHERE regexp_matches(html, '[A-Za-z]:[\\/]') HAVING count(*) > 0
UNION ALL SELECT 'wav_path', 'dataset_name', count(*) FROM p WHERE regexp_matches(url, '(?i)example\.net') HAVING count(*) > 0
UNION ALL SELECT 'body', 'dataset_name', count(*) FROM p WHERE regexp_matches(html, '(?i)example\.net') HAVING count(*) > 0
UNION ALL SELECT 'wav_path', 'forbidden_name', count(*) FROM p UNION ALL SELECT 'meta.gold_id', 'forbidden_name', count(*) FROM p""")
def leak_check(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        F.col("url").alias("wav_path"), F.col("html").alias("body"), F.struct(F.col("page_id").alias("gold_id")).alias("meta"))
    return ct.leak_report(p, {"raw_path": r"[A-Za-z]:[\\/]", "dataset_name": r"(?i)example\.net"})


def full_predictions(spark, sf_dir):
    """Prediction rows with a candidate map, and planted breaches of every kind of rule."""
    t = tokens(spark, sf_dir)
    names = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate([*SYMBOLS, inv.DELETE], 1)])
    t = t.withColumn("_w", F.transform(
        F.filter(names, lambda n: n["s"] != F.col("target")),
        lambda n: F.struct(n["s"].alias("s"), ((F.col("key") * 31 + n["i"] * n["i"] * 17 + F.col("k")) % 23 + 1).cast("double").alias("w"))))
    t = t.withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"]))
    scale = F.when(F.col("key") % 50 == 0, 2.0).otherwise(1.0)
    ranked = F.array_sort(F.transform("_w", lambda x: F.struct((-x["w"]).alias("w"), x["s"].alias("s"))))
    t = t.withColumns({"_scale": scale, "_r": ranked})
    t = t.withColumns({
        "candidates": F.map_from_arrays(
            F.transform("_w", lambda x: x["s"]), F.transform("_w", lambda x: x["w"] / F.col("_sum") * F.col("_scale"))),
        "p_alt": -F.get("_r", F.lit(0))["w"] / F.col("_sum") * F.col("_scale"),
        "margin": (F.get("_r", F.lit(1))["w"] - F.get("_r", F.lit(0))["w"]) / F.col("_sum") * F.col("_scale"),
        "top_alt": F.when(F.col("key") % 41 == 0, F.get("_r", F.lit(1))["s"]).otherwise(F.get("_r", F.lit(0))["s"]),
        "p_error": F.when(F.col("key") % 31 == 0, F.lit(1.5)).otherwise((F.col("k") + 0.5) / 100),
        "gop": F.col("k") / -10.0,
        "method": F.when(F.col("key") % 29 == 0, " ").otherwise("alpha"),
        "fold": F.lit("f1"),
        "idx": F.when(F.col("key") % 37 == 0, F.lit(-1)).otherwise(F.col("idx")),
        "realized": F.when((F.col("key") % 43 == 0) & (F.col("gold_event") == "match"), "nobody").otherwise(F.col("realized")),
    })
    return t.drop("_w", "_sum", "_r", "_scale")


FULL_SQL = TOKENS_SQL + """,
w AS (SELECT t.key, s, CAST((key * 31 + i * i * 17 + k) % 23 + 1 AS DOUBLE) AS w FROM tokens t,
  (VALUES ('click',1),('error',2),('purchase',3),('signup',4),('view',5),('<DEL>',6)) x(s, i) WHERE s <> target),
wr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, s) rn, sum(w) OVER (PARTITION BY key) tot FROM w),
wk AS (SELECT key, max(tot) tot, max(w) FILTER (WHERE rn = 1) w1, max(w) FILTER (WHERE rn = 2) w2, max(s) FILTER (WHERE rn = 1) s1,
  max(s) FILTER (WHERE rn = 2) s2, CASE WHEN key % 50 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END scale FROM wr GROUP BY key),
full_ AS (SELECT t.*, wk.* EXCLUDE (key), w1 / tot * scale AS p_alt, (w1 - w2) / tot * scale AS margin,
  CASE WHEN t.key % 41 = 0 THEN s2 ELSE s1 END AS top_alt, CASE WHEN t.key % 31 = 0 THEN 1.5::DOUBLE ELSE (k + 0.5::DOUBLE) / 100 END AS p_error FROM tokens t JOIN wk USING (key))"""


@query("row_contract", f"""WITH {FULL_SQL}
SELECT key, 'empty_method' AS violation FROM full_ WHERE key % 29 = 0
UNION ALL SELECT key, 'negative_index' FROM full_ WHERE key % 37 = 0
UNION ALL SELECT key, 'match_realized' FROM full_ WHERE key % 43 = 0 AND gold_event = 'match'
UNION ALL SELECT key, 'p_error_range' FROM full_ WHERE key % 31 = 0
UNION ALL SELECT key, 'p_alt_range' FROM full_ WHERE p_alt > 1
UNION ALL SELECT key, 'candidate_range' FROM full_ WHERE w1 / tot * scale > 1
UNION ALL SELECT key, 'candidate_sum' FROM full_ WHERE key % 50 = 0
UNION ALL SELECT key, 'top_candidate' FROM full_ WHERE key % 41 = 0""")
def row_contract(spark, sf_dir):
    return ct.prediction_violations(full_predictions(spark, sf_dir), ["key"], SYMBOLS)


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return ct.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("contiguous_index", """SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, CAST(min(l_linenumber) - 1 AS BIGINT) AS first,
 CAST(max(l_linenumber) - 1 AS BIGINT) AS last FROM lineitem GROUP BY l_orderkey
 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def contiguous_index(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("idx"))
    return ct.index_holes(li, ["l_orderkey"], "idx")


@query("normalization_audit", f"""WITH {TOKENS_SQL},
p AS (SELECT key, target_id, 0.7::DOUBLE + CASE WHEN key % 19 = 0 THEN 0.01 ELSE 0 END AS ok, CASE WHEN key % 23 = 0 THEN 0.25::DOUBLE ELSE 0.2 END AS sub FROM tokens)
SELECT key, 'event_sum' AS violation FROM p WHERE abs(ok + sub + 0.1 - 1) > 1e-7
UNION ALL SELECT key, 'substitution_marginal' FROM p WHERE (key % 23 = 0) <> (key % 29 = 0)
UNION ALL SELECT key, 'accepted_mass' FROM p WHERE key % 29 = 0""")
def normalization_audit(spark, sf_dir):
    """Event posteriors with planted breaches of each normalisation rule."""
    t = tokens(spark, sf_dir)
    leak = F.col("key") % 29 == 0
    ids = F.array(*[F.lit(i) for i in range(1, 6)])
    # 0.05 on each of four other symbols; a leak puts 0.05 on the accepted symbol as well.
    part = F.transform(ids, lambda i: F.when(i != F.col("target_id"), 0.05).when(leak, 0.05).otherwise(0.0))
    t = t.select(
        "key",
        (0.7 + F.when(F.col("key") % 19 == 0, 0.01).otherwise(0.0)).alias("ok"),
        F.when(F.col("key") % 23 == 0, 0.25).otherwise(0.2).alias("sub"), F.lit(0.1).alias("del"),
        part.alias("sub_parts"), F.array("target_id").alias("accepted"))
    return ct.normalization_violations(t, ["key"])


@query("decision_record", f"""WITH {FULL_SQL},
d AS (SELECT key, target, top_alt, p_alt, CASE WHEN key % 47 = 0 THEN NULL ELSE p_error END AS pe, margin FROM full_ WHERE key % 31 <> 0),
e AS (SELECT *, CASE WHEN pe IS NULL THEN 'abstain' WHEN pe < 0.5 THEN 'correct' WHEN p_alt >= 0.3 AND margin >= 0.05 AND top_alt <> target
  THEN CASE WHEN top_alt = '<DEL>' THEN 'deletion' ELSE 'substitution' END ELSE 'atypical_unspecified' END AS decision FROM d)
SELECT key, decision, CASE WHEN decision IN ('substitution', 'deletion') THEN top_alt END AS alternative,
 round(CASE WHEN decision IN ('substitution', 'deletion') THEN p_alt END, 8) AS alternative_probability, decision = 'abstain' AS abstain,
 decision IN ('substitution', 'deletion', 'atypical_unspecified') AS mention_error, decision IN ('substitution', 'deletion') AS mention_alternative FROM e""")
def decision_record(spark, sf_dir):
    p = full_predictions(spark, sf_dir).where("key % 31 <> 0")
    p = p.withColumn("p_error", F.when(F.col("key") % 47 != 0, F.col("p_error")))
    out = ct.decision_record(p, gate=0.3, min_margin=0.05)
    return rounded(out.select("key", "decision", "alternative", "alternative_probability", "abstain", "mention_error", "mention_alternative"),
                   "alternative_probability")


@query("stable_ids", f"""WITH {TOKENS_SQL},
u AS (SELECT *, 'utt_' || substr(sha256('{{"kind":"utt","namespace":"ns.v1","parts":["' || grp || '",' || event || '],"scheme":"local_deterministic_sha256.v1"}}' || chr(10)), 1, 20) AS recording_ref FROM tokens)
SELECT key, recording_ref, 'phone_' || substr(sha256('{{"kind":"phone","namespace":"ns.v1","parts":["' || recording_ref || '",' || idx || ',"' || target || '"],"scheme":"local_deterministic_sha256.v1"}}' || chr(10)), 1, 20) AS position_ref FROM u""")
def stable_ids(spark, sf_dir):
    return ct.runtime_ids(tokens(spark, sf_dir), "grp", "event", "idx", "target", "ns.v1").select("key", "recording_ref", "position_ref")
