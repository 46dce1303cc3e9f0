"""Registered queries: alignment, consensus and optimal labels, lexicon variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import texts as tx
from strophe.functions.inventory import VOWELS, phone_name
from strophe.operators import alignment as al
from strophe.operators import lattice as la
from strophe.operators import lexicon as lx
from strophe.plans.q_frames import TARGETS_SQL, matrices, targets
from strophe.plans.q_text import WORDS, documents
from strophe.plans.registry import query, rounded
from strophe.session import keyed
from strophe.plans.tables import PTOK_SQL, SYMBOLS, phone_tokens, table, tokens


PAIRS_SQL = PTOK_SQL + """,
pr AS (SELECT event, list(target ORDER BY idx) AS reference, flatten(list(seen ORDER BY idx)) AS observed FROM (SELECT event, idx, target,
  list_filter([realized, CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 1 THEN nm[k % 39 + 1] END], lambda x: x IS NOT NULL) AS seen FROM ptok) GROUP BY event),
pc AS (SELECT event, list_transform(reference, lambda s, i: CASE WHEN event % 4 = 0 AND i = 3 AND s <> 'AH' THEN [s, 'AH'] ELSE [s] END) AS accepted, observed,
  list_transform(reference, lambda s, i: (event + i - 1) % 11 <> 0) AS mask FROM pr)"""


def _matrix_sql(name: str, ref: str, obs: str) -> str:
    """Prefix cost rows of the accepted-set alignment, one recursion step per reference position."""
    return f"""
{name} AS (SELECT event, 0 AS i, range(0, len(observed) + 1) AS r FROM pc
 UNION ALL SELECT event, i + 1, list_transform(range(0, m + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda q: t[q + 1] + j - q))) FROM
  (SELECT f.event, f.i, len(observed) AS m, list_transform(range(0, len(observed) + 1), lambda j: CASE WHEN j = 0 THEN f.i + 1
     ELSE least(f.r[j + 1] + 1, f.r[j] + CASE WHEN list_contains(({ref})[f.i + 1], ({obs})[j]) THEN 0 ELSE 1 END) END) AS t FROM {name} f JOIN pc ON pc.event = f.event WHERE f.i < len(accepted)))"""


CELLS_SQL = _matrix_sql("wm", "accepted", "observed") + "," + _matrix_sql("vm", "list_reverse(accepted)", "list_reverse(observed)") + """,
fc AS (SELECT event, i, unnest(range(0, len(r))) AS j, unnest(r) AS f FROM wm),
bc AS (SELECT vm.event, len(accepted) - i AS i, len(observed) - unnest(range(0, len(r))) AS j, unnest(r) AS b FROM vm JOIN pc ON pc.event = vm.event),
op AS (SELECT event, max(f) FILTER (WHERE i = len(accepted) AND j = len(observed)) AS opt FROM fc JOIN pc USING (event) GROUP BY event),
del AS (SELECT fc.event, fc.i, fc.j FROM fc JOIN bc ON bc.event = fc.event AND bc.i = fc.i + 1 AND bc.j = fc.j JOIN op ON op.event = fc.event WHERE f + 1 + b = opt),
dia AS (SELECT fc.event, fc.i, fc.j, observed[fc.j + 1] AS symbol, list_contains(accepted[fc.i + 1], observed[fc.j + 1]) AS hit FROM fc JOIN bc ON bc.event = fc.event AND bc.i = fc.i + 1 AND bc.j = fc.j + 1
  JOIN op ON op.event = fc.event JOIN pc ON pc.event = fc.event WHERE f + CASE WHEN list_contains(accepted[fc.i + 1], observed[fc.j + 1]) THEN 0 ELSE 1 END + b = opt),
ins AS (SELECT fc.event, fc.i, fc.j FROM fc JOIN bc ON bc.event = fc.event AND bc.i = fc.i AND bc.j = fc.j + 1 JOIN op ON op.event = fc.event WHERE f + 1 + b = opt),
cand AS (SELECT event, i AS idx, 'deletion' AS kind, CAST(NULL AS VARCHAR) AS symbol FROM del UNION SELECT event, i, CASE WHEN hit THEN 'match' ELSE 'substitution' END, symbol FROM dia),
lab AS (SELECT cand.event, idx, any_value(mask[idx + 1]) AS ok, count(*) AS n, count(DISTINCT kind <> 'match') AS ne, bool_or(kind <> 'match') AS err, min(kind) AS kind, min(symbol) AS symbol,
  string_agg(kind || coalesce(':' || symbol, ''), ';' ORDER BY kind, symbol) AS candidates FROM cand JOIN pc ON pc.event = cand.event GROUP BY cand.event, idx),
ent AS (SELECT event, 0 AS gap, 0 AS s FROM pc UNION SELECT event, i + 1, j FROM del UNION SELECT event, i + 1, j + 1 FROM dia),
ext AS (SELECT event, len(accepted) AS gap, len(observed) AS e FROM pc UNION SELECT event, i, j FROM del UNION SELECT event, i, j FROM dia),
seq AS (SELECT DISTINCT ent.event, ent.gap, array_to_string(observed[s + 1:e], ',') AS q, e - s AS n FROM ent JOIN ext ON ext.event = ent.event AND ext.gap = ent.gap AND e >= s JOIN pc ON pc.event = ent.event
  WHERE e - s = (SELECT count(*) FROM ins WHERE ins.event = ent.event AND ins.i = ent.gap AND ins.j >= s AND ins.j < e)),
gp AS (SELECT seq.event, gap, (gap = 0 OR any_value(mask)[gap]) AND (gap = len(any_value(mask)) OR any_value(mask)[gap + 1]) AS ok, count(*) AS n, min(q) AS q, string_agg(q, ';' ORDER BY q) AS sequences, max(seq.n) AS longest
  FROM seq JOIN pc ON pc.event = seq.event GROUP BY seq.event, gap)"""


def pairs(spark, sf_dir):
    """Reference and observed phones of each recording: 8 positions, deletions and insertions."""
    t = phone_tokens(spark, sf_dir)
    extra = F.when(F.floor("value") % 4 == 1, phone_name(F.col("k") % 39 + 1))
    seen = F.filter(F.array("realized", extra), lambda s: s.isNotNull())
    return _sequence(t, "target", seen)


def _alignment(spark, sf_dir, cost):
    p = pairs(spark, sf_dir)
    a = p.select("event", F.posexplode(al.align(F.col("reference"), F.col("observed"), cost)).alias("step", "p"))
    return a.select("event", F.col("step").cast("long").alias("step"), F.col("p.r").cast("long").alias("r"), F.col("p.o").cast("long").alias("o"))


def _sequence(t, target, seen):
    rows = F.array_sort(F.collect_list(F.struct("idx", F.col(target).alias("t"), seen.alias("s"))))
    g = keyed(t, "event").groupBy("event", "grp").agg(rows.alias("r"))
    return g.select("event", "grp", F.transform("r", lambda x: x["t"]).alias("reference"), F.flatten(F.transform("r", lambda x: x["s"])).alias("observed"))


@query("edit_distance", """WITH t AS (SELECT event_id // 8 AS event, event_id % 8 AS idx, substr(event_type, 1, 1) c, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) k FROM events),
s AS (SELECT event, string_agg(c, '' ORDER BY idx) r, coalesce(string_agg(CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 4 THEN c || c WHEN k % 10 IN (1, 2, 3) THEN ['c','e','p','s','v'][k // 20 + 1] ELSE c END, '' ORDER BY idx), '') o FROM t GROUP BY event)
SELECT event, levenshtein(r, o) AS distance, levenshtein(r, o) AS set_distance FROM s""")
def edit_distance(spark, sf_dir):
    """Unit distance by the built-in function and, for the same pairs, by the accepted-set recursion."""
    m = F.col("k") % 10
    seen = (F.when(m == 0, F.array().cast("array<string>")).when(m == 4, F.array("target", "target"))
            .when(m.isin(1, 2, 3), F.array("alt")).otherwise(F.array("target")))
    p = _sequence(tokens(spark, sf_dir), "target", seen)
    ref, obs = F.col("reference"), F.col("observed")
    return p.select("event", al.edit_distance(ref, obs, SYMBOLS).cast("long").alias("distance"),
                    al.set_edit_distance(F.transform(ref, lambda s: F.array(s)), obs).cast("long").alias("set_distance"))


SQL_VOWELS = "(" + ", ".join(f"'{v}'" for v in sorted(VOWELS)) + ")"
SQL_COST = {
    "unit": "CASE WHEN {a} = {b} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END",
    "category": f"""CASE WHEN {{a}} = {{b}} THEN 0.0::DOUBLE WHEN ({{a}} IN {SQL_VOWELS}) = ({{b}} IN {SQL_VOWELS}) THEN 1.0::DOUBLE
      WHEN {{a}} || '|' || {{b}} IN ('Y|IY', 'IY|Y', 'W|UW', 'UW|W') THEN 0.6::DOUBLE ELSE 2.2::DOUBLE END""",
}


def _trace_sql(n: str, cost: str) -> str:
    """Cost rows (left to right, so sums keep their order), the back-trace, and per-position labels."""
    c = SQL_COST[cost]
    return f"""
m{n} AS (SELECT event, 0 AS i, list_transform(range(0, len(observed) + 1), lambda j: CAST(j AS DOUBLE)) AS r FROM pr
 UNION ALL SELECT event, i + 1, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1.0))) FROM
  (SELECT f.event, f.i, list_transform(range(0, len(observed) + 1), lambda j: CASE WHEN j = 0 THEN f.r[1] + 1.0 ELSE least(f.r[j] + {c.format(a="reference[f.i + 1]", b="observed[j]")}, f.r[j + 1] + 1.0) END) AS t
   FROM m{n} f JOIN pr ON pr.event = f.event WHERE f.i < len(reference))),
f{n} AS (SELECT event, list(r ORDER BY i) AS f FROM m{n} GROUP BY event),
t{n} AS (SELECT event, len(reference) AS i, len(observed) AS j, -1 AS back, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS o FROM pr
 UNION ALL SELECT x.event, CASE WHEN mv = 3 THEN i ELSE i - 1 END, CASE WHEN mv = 2 THEN j ELSE j - 1 END, back + 1, CASE WHEN mv <> 3 THEN i - 1 END, CASE WHEN mv <> 2 THEN j - 1 END FROM
  (SELECT q.*, CASE WHEN q.i > 0 AND q.j > 0 AND f[q.i][q.j] + {c.format(a="reference[q.i]", b="observed[q.j]")} = f[q.i + 1][q.j + 1] THEN 1
     WHEN q.i > 0 AND (q.j = 0 OR f[q.i][q.j + 1] + 1.0 = f[q.i + 1][q.j + 1]) THEN 2 ELSE 3 END AS mv FROM t{n} q JOIN f{n} ON f{n}.event = q.event JOIN pr ON pr.event = q.event WHERE q.i > 0 OR q.j > 0) x),
l{n} AS (SELECT t.event, r AS idx, observed[o + 1] AS realized, CASE WHEN o IS NULL THEN 'deletion' WHEN observed[o + 1] = reference[r + 1] THEN 'match' ELSE 'substitution' END AS kind
  FROM t{n} t JOIN pr ON pr.event = t.event WHERE back >= 0 AND r IS NOT NULL)"""


STEPS_SQL = "SELECT event, CAST(max(back) OVER (PARTITION BY event) - back AS BIGINT) AS step, r, o FROM t0 WHERE back >= 0"


@query("align_unit", f"WITH RECURSIVE {PAIRS_SQL}, {_trace_sql('0', 'unit')} {STEPS_SQL}")
def align_unit(spark, sf_dir):
    return _alignment(spark, sf_dir, al.unit_cost)


@query("align_category", f"WITH RECURSIVE {PAIRS_SQL}, {_trace_sql('0', 'category')} {STEPS_SQL}")
def align_category(spark, sf_dir):
    return _alignment(spark, sf_dir, al.category_cost)


BOTH_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, {_trace_sql('1', 'unit')}, {_trace_sql('2', 'category')},
gr AS (SELECT DISTINCT event, grp FROM ptok),
bo AS (SELECT l1.event, grp, l1.idx, l1.kind AS unit_event, l2.kind AS category_event, l1.realized AS unit_realized, l2.realized AS category_realized,
  l1.kind = l2.kind AND l1.realized IS NOT DISTINCT FROM l2.realized AS stable FROM l1 JOIN l2 ON l2.event = l1.event AND l2.idx = l1.idx JOIN gr ON gr.event = l1.event)"""


@query("consensus_labels", f"""{BOTH_SQL} SELECT event, grp, idx, stable, CASE WHEN stable THEN unit_event ELSE 'alignment_uncertain' END AS event_type, CASE WHEN stable THEN unit_realized END AS realized,
 unit_event, category_event, unit_realized, category_realized FROM bo""")
def consensus_labels(spark, sf_dir):
    tok, _ = al.consensus_labels(pairs(spark, sf_dir), ["event", "grp"], "reference", "observed")
    return tok.withColumn("idx", F.col("idx").cast("long"))


@query("consensus_summary", f"""{BOTH_SQL},
i1 AS (SELECT event, o FROM t1 WHERE back >= 0 AND r IS NULL), i2 AS (SELECT event, o FROM t2 WHERE back >= 0 AND r IS NULL), ix AS (SELECT event, o FROM i1 INTERSECT SELECT event, o FROM i2)
SELECT bo.event, grp, count(*) n_positions, count(*) FILTER (WHERE stable) n_stable, round(avg(CAST(stable AS INT)), 8) stable_fraction, (SELECT count(*) FROM i1 WHERE i1.event = bo.event) unit_insertions,
 (SELECT count(*) FROM i2 WHERE i2.event = bo.event) category_insertions, (SELECT count(*) FROM ix WHERE ix.event = bo.event) agreed_insertions, avg(CAST(stable AS INT)) >= 0.8 AS eligible FROM bo GROUP BY bo.event, grp""")
def consensus_summary(spark, sf_dir):
    out = al.consensus_labels(pairs(spark, sf_dir), ["event", "grp"], "reference", "observed")[1]
    counts = ("n_positions", "n_stable", "unit_insertions", "category_insertions", "agreed_insertions")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in counts}), "stable_fraction")


def _cells(spark, sf_dir):
    """Reference positions accept a second phone on every fourth event."""
    p = pairs(spark, sf_dir)
    acc = F.transform("reference", lambda s, i: F.when((F.col("event") % 4 == 0) & (i == 2), F.array(s, F.lit("AH"))).otherwise(F.array(s)))
    diag = F.transform("reference", lambda s, i: (F.col("event") + i) % 11 != 0)
    p = p.select("event", F.transform(acc, lambda a: F.array_distinct(a)).alias("accepted"), "observed", diag.alias("mask"))
    return al.optimal_cells(p, "accepted", "observed")


@query("optimal_labels", f"""WITH RECURSIVE {PAIRS_SQL}, {CELLS_SQL}
SELECT lab.event, CAST(idx AS BIGINT) idx, ok AS diagnostic, CASE WHEN ok AND ne = 1 THEN err END is_error, ok AND ne = 1 AS stable_error, ok AND n = 1 AS stable_event,
 CASE WHEN ok AND n = 1 THEN kind ELSE 'alignment_uncertain' END event_type, CASE WHEN ok AND n = 1 THEN symbol END realized, candidates, CAST(opt AS BIGINT) distance FROM lab JOIN op USING (event)""")
def optimal_labels(spark, sf_dir):
    out = al.optimal_labels(_cells(spark, sf_dir), ["event"], "accepted", "observed", "mask")
    text = F.concat_ws(";", F.transform("candidates", lambda c: F.concat_ws(":", c["event"], c["symbol"])))
    return out.withColumns({"candidates": text, "idx": F.col("idx").cast("long"), "distance": F.col("distance").cast("long")})


@query("gap_labels", f"""WITH RECURSIVE {PAIRS_SQL}, {CELLS_SQL}
SELECT event, CAST(gap AS BIGINT) gap, ok AS diagnostic, ok AND n = 1 AS stable, CASE WHEN ok AND n = 1 THEN q ELSE '' END inserted, sequences, CAST(longest AS BIGINT) n_ordinals FROM gp""")
def gap_labels(spark, sf_dir):
    out = al.gap_labels(_cells(spark, sf_dir), ["event"], "accepted", "observed", "mask")
    return out.select("event", F.col("gap").cast("long").alias("gap"), "diagnostic", "stable", F.concat_ws(",", "inserted").alias("inserted"),
                      F.concat_ws(";", F.transform("sequences", lambda s: F.concat_ws(",", s))).alias("sequences"), F.size("ordinals").cast("long").alias("n_ordinals"))


GREEDY_SQL = TARGETS_SQL + """,
gb AS (SELECT event, frame, arg_max(symbol, logp * 1.0 - symbol * 1e-15) s FROM lp GROUP BY ALL),
gc AS (SELECT *, lag(s) OVER (PARTITION BY event ORDER BY frame) prev FROM gb),
pc AS (SELECT tg.event, list_transform(any_value(labels), lambda s: [CAST(s AS VARCHAR)]) AS accepted,
  coalesce(list(CAST(s AS VARCHAR) ORDER BY frame) FILTER (WHERE s <> 0 AND (prev IS NULL OR prev <> s)), []) AS observed, list_transform(any_value(labels), lambda s: TRUE) AS mask
  FROM tg JOIN gc ON gc.event = tg.event GROUP BY tg.event)"""


@query("greedy_label_scores", f"""WITH RECURSIVE {GREEDY_SQL}, {CELLS_SQL},
sl AS (SELECT gp.event, gap, o, count(DISTINCT coalesce(split_part(nullif(q2, ''), ',', o + 1), '')) AS kinds, bool_or(seq_n > o) AS some, bool_and(seq_n > o) AS every_, max(split_part(q2, ',', o + 1)) AS sym, longest
  FROM gp JOIN (SELECT event AS e2, gap AS g2, q AS q2, n AS seq_n FROM seq) ON e2 = gp.event AND g2 = gp.gap, (VALUES (0), (1)) x(o) GROUP BY gp.event, gap, o, longest)
SELECT event, 'position' AS kind, CAST(idx AS BIGINT) AS "at", CASE WHEN ne = 1 THEN CASE WHEN err THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END gop, CASE WHEN n = 1 THEN lab.kind ELSE 'unspecified' END cand_event,
  CASE WHEN n = 1 AND lab.kind = 'substitution' THEN symbol END cand_symbol, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END cand_conf FROM lab
UNION ALL SELECT event, 'gap', CAST(gap * 2 + o AS BIGINT), CASE WHEN o >= longest THEN 0.0 WHEN kinds = 1 THEN CASE WHEN every_ THEN 1.0 ELSE 0.0 END ELSE 0.5 END, NULL,
  CASE WHEN o < longest AND kinds = 1 THEN nullif(sym, '') END, CASE WHEN o >= longest OR kinds = 1 THEN 1.0 ELSE 0.0 END FROM sl""")
def greedy_label_scores(spark, sf_dir):
    g = matrices(spark, sf_dir).select("event", F.transform(la.greedy_symbols(F.col("matrix")), lambda s: s.cast("string")).alias("observed"))
    acc = F.transform("labels", lambda s: F.array(s.cast("string")))
    cells = al.optimal_cells(g.join(targets(spark, sf_dir), "event").select("event", acc.alias("accepted"), "observed"), "accepted", "observed")
    tok, slots = al.greedy_label_scores(al.optimal_labels(cells, ["event"], "accepted", "observed"), al.gap_labels(cells, ["event"], "accepted", "observed"), ["event"])
    return tok.select("event", F.lit("position").alias("kind"), F.col("idx").cast("long").alias("at"), "gop", "cand_event", "cand_symbol", "cand_conf").unionByName(
        slots.select("event", F.lit("gap").alias("kind"), (F.col("gap") * 2 + F.col("ordinal")).cast("long").alias("at"), F.col("insertion_probability").alias("gop"),
                     F.lit(None).cast("string").alias("cand_event"), F.col("slot_symbol").alias("cand_symbol"), "cand_conf"))


def variant_lexicon(spark, sf_dir):
    """Letters as symbols; a and i are the weak pair, and five kinds of variants are planted."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    n, first = F.length("word"), F.instr("word", "a")
    last = F.when(first > 0, n - F.instr(F.reverse("word"), "a") + 1).otherwise(0)
    put = lambda at, c: F.concat(F.substring("word", F.lit(1), at - 1), F.lit(c), F.substring("word", at + 1, n))
    forms = F.array(
        F.struct(F.lit(1).alias("variant"), F.col("word").alias("form"), F.lit("0").alias("stress")),
        F.struct(F.lit(2).alias("variant"), F.when(first > 0, put(first, "i")).alias("form"), F.lit("0").alias("stress")),
        F.struct(F.lit(3).alias("variant"), F.when(n % 3 == 0, F.substring("word", F.lit(1), n - 1)).alias("form"), F.lit("0").alias("stress")),
        F.struct(F.lit(4).alias("variant"), F.when((n % 4 == 0) & (last > first), put(last, "i")).alias("form"), F.lit("0").alias("stress")),
        F.struct(F.lit(5).alias("variant"), F.when((n % 5 == 0) & (first > 0), F.col("word")).alias("form"), F.lit("1").alias("stress")))
    f = w.select("word", F.explode(forms).alias("f")).select("word", "f.*").where("form IS NOT NULL AND form <> ''")
    spell = lambda c: F.when(c == "a", F.concat(F.lit("AH"), F.col("stress"))).when(c == "i", "IH0").otherwise(F.upper(c))
    return f.select("word", "variant", F.transform(F.split("form", ""), spell).alias("symbols"))


@query("variant_positions", f"""WITH w AS (SELECT DISTINCT unnest({WORDS}) word FROM benchmark),
p AS (SELECT word, length(word) n, instr(word, 'a') f, CASE WHEN instr(word, 'a') > 0 THEN length(word) - instr(reverse(word), 'a') + 1 ELSE 0 END l, starts_with(word, 'th') blocked FROM w),
q AS (SELECT *, f > 0 v2, n % 3 = 0 AND n > 1 v3, n % 4 = 0 AND l > f v4, n % 5 = 0 AND f > 0 v5 FROM p)
SELECT word, 1 + CAST(v2 AS INT) + CAST(v3 AS INT) + CAST(v4 AS INT) + CAST(v5 AS INT) AS n_variants, NOT (blocked OR v3 OR (v2 AND v4)) AS diagnostic,
 CAST(CASE WHEN NOT blocked AND v2 AND NOT v4 THEN 1 ELSE 0 END AS INT) variant_positions,
 array_to_string(list_sort(list_filter([CASE WHEN blocked THEN 'context_ambiguous_homograph' END, CASE WHEN v3 AND NOT blocked THEN 'length_changing_variant_unavailable' END,
  CASE WHEN v2 AND v4 AND NOT blocked THEN 'multiple_variant_positions_would_invent_combinations' END], lambda x: x IS NOT NULL)), ',') reasons FROM q""")
def variant_positions(spark, sf_dir):
    out = lx.variant_positions(variant_lexicon(spark, sf_dir), blocked=F.col("word").startswith("th"))
    return out.select("word", "n_variants", "diagnostic", "variant_positions", F.concat_ws(",", "reasons").alias("reasons"))


@query("word_context", f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM t),
c AS (SELECT *, lag(word) OVER d lw, lead(word) OVER d rw, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) e FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) n_words, CAST(sum(e - length(word)) AS BIGINT) start_sum, CAST(max(e) AS BIGINT) n_symbols, count(*) FILTER (WHERE lw = rw) same_neighbours, max(rw) FILTER (WHERE pos = 1) second_word FROM c GROUP BY doc_id""")
def word_context(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "word"))
    c = al.word_context(w, "doc_id", "pos", "word", F.length("word").cast("long"))
    return c.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("start").alias("start_sum"), F.max("end").alias("n_symbols"),
        F.count_if(F.col("left_word") == F.col("right_word")).alias("same_neighbours"), F.max(F.when(F.col("pos") == 0, F.col("right_word"))).alias("second_word"))
