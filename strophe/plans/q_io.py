"""Registered queries: sources, sinks, feedback, streaming and the mapper hook."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strophe.functions.hooks import map_texts
from strophe.operators import feedback as fb
from strophe.operators.audits import group_summary
from strophe.plans.q_audits import SEGMENTS_SQL, segments
from strophe.plans.q_text import WORDS
from strophe.plans.registry import query, rounded
from strophe.plans.tables import METHODS, SCORED_ALL_SQL, TOKENS_SQL, table, tokens, with_methods
from strophe.functions import texts as tx
from strophe.sources import labels as lb
from strophe.sources import records as rc
from strophe.session import shared_dir
from strophe.streaming import online as on


def scratch(spark, name: str) -> str:
    """A fresh folder on the cluster's shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------

@query("src_jsonl", f"""WITH {TOKENS_SQL} SELECT key, target, k, NULL AS reason FROM tokens WHERE key % 97 <> 1 AND key % 89 <> 2 AND key % 83 <> 3 AND key % 79 <> 4
UNION ALL SELECT NULL, CASE WHEN key % 97 = 1 THEN 'invalid_json' WHEN key % 89 = 2 THEN 'blank_line' WHEN key % 83 = 3 THEN 'not_an_object' ELSE 'trailing_text' END, count(*), 'quarantine' FROM tokens
WHERE key % 97 = 1 OR key % 89 = 2 OR key % 83 = 3 OR key % 79 = 4 GROUP BY ALL""")
def src_jsonl(spark, sf_dir):
    """Lines with planted broken, blank and non-object records, and text after the object; quarantine is counted by reason."""
    path = scratch(spark, "jsonl")
    line = (F.when(F.col("key") % 97 == 1, F.lit('{"key": 5, "tar')).when(F.col("key") % 89 == 2, " ").when(F.col("key") % 83 == 3, "[1, 2]")
            .when((F.col("key") % 79 == 4) & (F.col("key") % 2 == 0), F.lit('{"key": 5, "target": "a } \\" {"} {"key": 6}'))
            .when(F.col("key") % 79 == 4, F.lit('{"key": 5, "k": 1} junk')).otherwise(F.to_json(F.struct("key", "target", "k"))))
    tokens(spark, sf_dir).select(line.alias("value")).write.option("compression", "gzip").text(path)
    good, bad = rc.read_jsonl(spark, path, "key bigint, target string, k bigint")
    per = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("k"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        per.select(F.lit(None).cast("bigint").alias("key"), F.col("reason").alias("target"), "k", F.lit("quarantine").alias("reason")))


@query("sink_jsonl", f"WITH {TOKENS_SQL} SELECT key, grp, target, realized, stable_event FROM tokens")
def sink_jsonl(spark, sf_dir):
    path = scratch(spark, "out-jsonl")
    rc.write_jsonl(tokens(spark, sf_dir).select("key", "grp", "target", "realized", "stable_event"), path, ["key"], files=4)
    return rc.read_jsonl(spark, path, "key bigint, grp string, target string, realized string, stable_event boolean")[0]


@query("sink_csv", f"WITH {TOKENS_SQL} SELECT grp, target, count(*) AS n, round(avg(value), 8) AS mean_value FROM tokens GROUP BY ALL")
def sink_csv(spark, sf_dir):
    path = scratch(spark, "out-csv")
    t = tokens(spark, sf_dir).groupBy("grp", "target").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    rc.write_csv(rounded(t, "mean_value"), path)
    return spark.read.schema("grp string, target string, n bigint, mean_value double").option("header", True).csv(path)


@query("src_file_index", r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) h, page_id % 3 = 0 AS up FROM pages)
SELECT h || '.lab' AS stem, count(*) AS n FROM p GROUP BY h""")
def src_file_index(spark, sf_dir):
    """One label file per host and spelling; the stem folds case, so both spellings stay visible."""
    path = scratch(spark, "files")
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    stem = F.concat(F.when(F.col("page_id") % 3 == 0, F.upper(host)).otherwise(host), F.lit(".lab"))
    pages = table(spark, sf_dir, "pages").select(stem.alias("stem"), F.col("url").alias("value"))
    pages.repartition("stem").write.partitionBy("stem").text(path)
    return rc.file_index(spark, path, ".txt", stem=r"stem=([^/]+)/").select("stem", "n")


@query("src_interval_labels", f"""WITH {SEGMENTS_SQL}, l AS (SELECT event, idx, CASE WHEN (event * 8 + idx) % 101 = 1 THEN 'too_few_fields' WHEN (event * 8 + idx) % 103 = 2 THEN 'invalid_bounds'
  WHEN (event * 8 + idx) % 107 = 3 THEN 'non_positive_interval' END reason, label, "start" s, "end" e FROM seg)
SELECT reason, CASE WHEN reason IS NULL THEN label END AS label, count(*) n, CAST(sum(CASE WHEN reason IS NULL THEN e - s END) AS BIGINT) samples FROM l GROUP BY ALL""")
def src_interval_labels(spark, sf_dir):
    path = scratch(spark, "intervals")
    s = segments(spark, sf_dir).withColumn("key", F.col("event") * 8 + F.col("idx"))
    line = (F.when(F.col("key") % 101 == 1, F.concat_ws(" ", "start", "end")).when(F.col("key") % 103 == 2, F.concat_ws(" ", F.lit("x"), "end", "label"))
            .when(F.col("key") % 107 == 3, F.concat_ws(" ", "end", "start", "label")).otherwise(F.concat_ws("  ", "start", "end", "label")))
    s.select(F.concat(F.lit(" "), line).alias("value")).write.text(path)
    p = lb.parse_interval_lines(spark.read.text(path))
    ok = F.col("reason").isNull()
    return p.groupBy("reason", F.when(ok, F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, F.col("end") - F.col("start"))).alias("samples"))


@query("src_lexicon", f"""WITH w AS (SELECT DISTINCT unnest({WORDS}) word FROM benchmark)
SELECT word, CAST(1 AS INT) AS variant, array_to_string(list_transform(string_split(word, ''), lambda c: upper(c)), ' ') symbols FROM w WHERE NOT contains(word, '#')
UNION ALL SELECT word, CAST(2 AS INT), array_to_string(list_transform(string_split(reverse(word), ''), lambda c: upper(c)), ' ') FROM w WHERE length(word) % 3 = 0 AND reverse(word) <> word""")
def src_lexicon(spark, sf_dir):
    """A dictionary text with comments, variant suffixes and a repeated pronunciation per word."""
    path = scratch(spark, "lexicon")
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    spell = lambda c: F.concat_ws(" ", F.transform(F.split(c, ""), lambda s: F.upper(s)))
    lines = F.array(
        F.concat(F.lit(";;; note on "), F.col("word")),
        F.concat(F.upper("word"), F.lit("  "), spell(F.col("word")), F.lit(" # first")),
        F.when(F.length("word") % 3 == 0, F.concat(F.col("word"), F.lit("(2) "), spell(F.reverse("word")))),
        F.concat(F.col("word"), F.lit("(3) "), spell(F.col("word"))), F.lit("# nothing"), F.lit(""))
    w.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value")).write.text(path)
    lex = lb.read_lexicon(spark, path)
    return lex.select("word", "variant", F.concat_ws(" ", "symbols").alias("symbols"))


@query("src_section_csv", """WITH c AS (SELECT c_custkey // 100 AS grp, c_custkey, chr(CAST(97 + c_custkey % 7 AS INT)) || CASE WHEN c_custkey % 4 = 0 THEN '/' || chr(CAST(97 + c_custkey % 5 AS INT)) ELSE '' END g, 'item' || CAST(c_custkey % 40 AS VARCHAR) k FROM customer),
l AS (SELECT grp, k, arg_max(g, c_custkey) g FROM c GROUP BY ALL),
p AS (SELECT grp, k, g, unnest(string_split(g, '/')) x FROM l), s AS (SELECT grp, k, g, avg(CASE WHEN x BETWEEN 'a' AND 'e' THEN ascii(x) - 96 END) v FROM p GROUP BY ALL)
SELECT grp, round(avg(v), 8) score, string_agg(k || '=' || g, ';' ORDER BY k) AS label FROM s GROUP BY grp""")
def src_section_csv(spark, sf_dir):
    """Notes of each group (a hundred customers): a heading, graded lines, then another section that must not count."""
    path = scratch(spark, "notes")
    c = table(spark, sf_dir, "customer")
    grade = F.concat(F.char(97 + F.col("c_custkey") % 7), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("/"), F.char(97 + F.col("c_custkey") % 5))).otherwise(""))
    item = F.concat(F.lit("Item"), (F.col("c_custkey") % 40).cast("string"))
    body = c.select(F.expr("c_custkey div 100").alias("grp"), F.col("c_custkey").alias("o"), F.concat_ws(",", F.lit(""), item, grade, F.lit("x")).alias("value"))
    marks = {-3: "General,,", -2: ",Early,a", -1: "Intelligibility,rating,", 1 << 40: "Other,,", (1 << 40) + 1: ",Late,e"}
    marks = F.array(*[F.struct(F.lit(o).cast("bigint").alias("o"), F.lit(v).alias("value")) for o, v in marks.items()])
    heads = c.select(F.expr("c_custkey div 100").alias("grp")).distinct().select("grp", F.explode(marks).alias("h")).select("grp", "h.o", "h.value")
    lines = body.unionByName(heads).repartition("grp").sortWithinPartitions("grp", "o")
    lines.select("grp", "value").write.partitionBy("grp").text(path)
    notes = lb.read_section_notes(spark, path, "intel", "grp")
    # The heading line itself names a column, not a graded item.
    label = F.array_join(F.filter(F.split("label", ";"), lambda x: x != "rating="), ";")
    return rounded(notes.select(F.col("grp").cast("long").alias("grp"), "score", label.alias("label")), "score")


# --- feedback ------------------------------------------------------------------------------------

POSITIONS_SQL = SCORED_ALL_SQL + """,
pos AS (SELECT event * 3 + mi AS event, idx, idx // 2 AS word, target, diagnostic AS assessed, predicted AS flagged, p_error,
   ['one', 'two', 'three', 'four'][k % 4 + 1] AS text FROM scored_all)"""


def positions_by_word(spark, sf_dir):
    """Two positions per word, four words per recording; every method's scores are a recording of their own."""
    s = with_methods(tokens(spark, sf_dir))
    mi = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method")) - 1
    return s.select((F.col("event") * 3 + mi).alias("event"), "idx", F.expr("idx div 2").alias("word"), "target", F.col("diagnostic").alias("assessed"),
                    F.col("predicted").alias("flagged"), "p_error", F.element_at(F.array(*[F.lit(w) for w in ("one", "two", "three", "four")]), (F.col("k") % 4 + 1).cast("int")).alias("text"))


ROLLUP_SQL = """roll AS (SELECT event, word, count(*) n_positions, count(*) FILTER (WHERE assessed) n_assessed, count(*) FILTER (WHERE assessed AND flagged) n_review FROM pos GROUP BY ALL),
words AS (SELECT *, CASE WHEN n_review > 0 THEN 'review' WHEN n_assessed < n_positions THEN 'unassessed' ELSE 'no_flag' END status FROM roll)"""


@query("word_rollup", f"WITH {POSITIONS_SQL}, {ROLLUP_SQL} SELECT * FROM words")
def word_rollup(spark, sf_dir):
    return fb.word_rollup(positions_by_word(spark, sf_dir), ["event", "word"])


@query("review_topk", f"""WITH {POSITIONS_SQL}, h AS (SELECT event, word, max(p_error) p, string_agg(target, ',' ORDER BY idx) FILTER (WHERE TRUE) t, min(target) a, max(target) b FROM pos WHERE assessed AND flagged GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY p DESC, word) "rank" FROM h)
SELECT event, word, round(p, 8) p_max, CASE WHEN a = b THEN a ELSE t END targets, CAST("rank" AS BIGINT) "rank" FROM r WHERE "rank" <= 3""")
def review_topk(spark, sf_dir):
    out = fb.review_topk(positions_by_word(spark, sf_dir), "event", "word")
    return rounded(out.select("event", "word", "p_max", F.concat_ws(",", "targets").alias("targets"), F.col("rank").cast("long").alias("rank")), "p_max")


@query("render_text", f"""WITH {POSITIONS_SQL},
wd AS (SELECT event, word, arg_min(text, idx) AS wt, count(*) n, count(*) FILTER (WHERE assessed) a, count(*) FILTER (WHERE assessed AND flagged) r, max(p_error) FILTER (WHERE assessed AND flagged) p,
  list(target ORDER BY idx) FILTER (WHERE assessed AND flagged) t FROM pos GROUP BY ALL),
wn AS (SELECT *, CAST(to_json(wt) AS VARCHAR) AS q, list_filter(t, lambda x, i: list_position(t, x) = i) AS td FROM wd),
w AS (SELECT *, array_to_string(list_transform(td, lambda x: '/' || x || '/'), ', ') AS sounds, row_number() OVER (PARTITION BY event, r > 0 ORDER BY p DESC, word) rk FROM wn),
e AS (SELECT event, CAST(sum(a) AS BIGINT) a, CAST(sum(r) AS BIGINT) r, CAST(sum(n - a) AS BIGINT) u, count(*) FILTER (WHERE r > 0) w,
  string_agg('word ' || word + 1 || ' ' || q, ', ' ORDER BY word) FILTER (WHERE r = 0 AND a < n) gaps,
  string_agg('Review word ' || word + 1 || ', ' || q || ', paying attention to the target sound(s) ' || sounds || '. Replay the full recording, then try the practice text again if you wish.', chr(10) || chr(10) ORDER BY rk) FILTER (WHERE r > 0 AND rk <= 3) items
  FROM w GROUP BY event)
SELECT event, CASE WHEN r > 0 THEN 'review' WHEN a > 0 THEN 'no_flag' ELSE 'unassessed' END intro_id,
 CASE WHEN r > 0 THEN 'The model flagged ' || r || ' of ' || a || ' assessed target sounds across ' || w || ' word(s) for review. A flag suggests a place to listen again; it does not establish a specific pronunciation error.'
  WHEN a > 0 THEN 'No positions were flagged among ' || a || ' assessed target sounds. This does not establish that every sound was correct. You can replay the full recording and try the practice text again.'
  ELSE 'There were no assessed target sounds. No pronunciation judgment is available. You can replay the full recording or choose another practice text.' END || ' ' || u || ' target sound(s) were not assessed.'
  || CASE WHEN gaps IS NULL THEN '' ELSE ' Unassessed words: ' || gaps || '.' END || CASE WHEN w > 3 THEN ' This message focuses on 3 of the flagged words.' ELSE '' END || CASE WHEN items IS NULL THEN '' ELSE chr(10) || chr(10) || items END AS text,
 CAST(least(w, 3) AS INT) AS n_items FROM e""")
def render_text(spark, sf_dir):
    return fb.feedback_text(positions_by_word(spark, sf_dir), "event", "word")


@query("summary_text_check", f"""WITH {POSITIONS_SQL}, g AS (SELECT event, target, count(*) FILTER (WHERE assessed AND flagged) f, count(*) FILTER (WHERE assessed) a, len(list(text ORDER BY idx) FILTER (WHERE assessed AND flagged)) n,
  len(list_distinct(list(text) FILTER (WHERE assessed AND flagged))) nd FROM pos GROUP BY ALL)
SELECT event, target, event % 13 <> 0 AS parseable, event % 13 <> 0 AS symbol_correct, event % 13 <> 0 AND event % 11 <> 0 AS flagged_correct, event % 13 <> 0 AS assessed_correct,
 event % 13 <> 0 AND (event % 7 <> 0 OR coalesce(n, 0) = coalesce(nd, 0)) AS words_correct, event % 13 <> 0 AND event % 11 <> 0 AND (event % 7 <> 0 OR coalesce(n, 0) = coalesce(nd, 0)) AS success FROM g""")
def summary_text_check(spark, sf_dir):
    """Sentences rendered from the counts, with planted faults: no sentence, a wrong count, lost repetitions."""
    p = positions_by_word(spark, sf_dir).select("event", "target", "idx", F.col("text").alias("word"), "assessed", "flagged")
    g = group_summary(p, ["event", "target"], "idx")
    shown = F.when(F.col("event") % 7 == 0, F.array_distinct("flagged_words")).otherwise(F.col("flagged_words"))
    said = fb.render_count_sentence(g.withColumns({"truth": F.col("flagged"), "flagged": F.when(F.col("event") % 11 == 0, F.col("flagged") + 1).otherwise(F.col("flagged")), "_w": shown}), "_w")
    said = said.withColumns({"flagged": F.col("truth"), "sentence": F.when(F.col("event") % 13 == 0, "All sounds were fine.").otherwise(F.concat(F.lit("  "), "sentence"))})
    out = fb.check_count_sentence(said, "sentence", "flagged_words")
    return out.select("event", "target", "parseable", "symbol_correct", "flagged_correct", "assessed_correct", "words_correct", "success")


@query("sentence_check", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents), t AS (SELECT doc_id, trim(s, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || '"“”') AS s FROM l),
w AS (SELECT doc_id, s, regexp_extract_all(lower(s), '[a-z]+') w, regexp_matches(s, '^[A-Za-z ]+[.!?]?$') plain FROM t)
SELECT doc_id, count(*) n, count(*) FILTER (WHERE list_contains(w, 'the')) n_target, count(*) FILTER (WHERE len(w) BETWEEN 5 AND 10) n_length, count(*) FILTER (WHERE plain) n_plain,
 count(*) FILTER (WHERE w <> ['the', 'and']) n_different, CAST(sum(len(list_distinct(list_filter(w, lambda x: x NOT IN ('the', 'and', 'of', 'in', 'to'))))) AS BIGINT) n_outside,
 count(*) FILTER (WHERE list_contains(w, 'the') AND len(w) BETWEEN 5 AND 10 AND plain AND w <> ['the', 'and']) n_success FROM w GROUP BY doc_id""")
def sentence_check(spark, sf_dir):
    """Every sentence of every document checked against one target and a small vocabulary."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\.")).alias("s"))
    d = d.withColumns({"targets": F.array(F.lit("the")), "orig": F.lit("The and.")})
    c = fb.sentence_check(d, "s", "targets", "orig", ["the", "and", "of", "in", "to"])
    return c.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("target_coverage").alias("n_target"), F.count_if("word_count_ok").alias("n_length"),
        F.count_if("one_plain_sentence").alias("n_plain"), F.count_if("different").alias("n_different"), F.sum(F.size("outside").cast("long")).alias("n_outside"),
        F.count_if("success").alias("n_success"))


@query("choice_check", f"""WITH {POSITIONS_SQL}, {ROLLUP_SQL}, e AS (SELECT event, max(n_review) > 0 AS has, count(*) FILTER (WHERE n_review > 0) nw FROM words GROUP BY event)
SELECT event, CASE WHEN event % 17 = 0 THEN 'not_json' WHEN event % 17 = 1 THEN 'wrong_fields' WHEN event % 17 = 2 THEN 'intro_not_allowed' WHEN event % 17 = 3 AND has THEN 'items_not_distinct_allowed' WHEN event % 17 = 4 THEN 'items_not_distinct_allowed'
  WHEN event % 17 = 5 AND has THEN 'wrong_number_of_items' WHEN nw > 3 THEN 'wrong_number_of_items' WHEN event % 17 = 3 AND FALSE THEN '' END AS reason FROM e""".replace("WHEN nw > 3 THEN 'wrong_number_of_items'", "WHEN nw > 3 AND event % 17 <> 5 THEN 'wrong_number_of_items'"))
def choice_check(spark, sf_dir):
    """JSON choices of review items with planted faults of every kind."""
    w = fb.word_rollup(positions_by_word(spark, sf_dir), ["event", "word"])
    ids = F.array_sort(F.collect_list(F.when(F.col("status") == "review", F.concat(F.lit("review_word_"), F.col("word").cast("string")))))
    e = w.groupBy("event").agg(ids.alias("items")).withColumn("intros", F.array(F.when(F.size("items") > 0, "review").otherwise("no_flag")))
    m = F.col("event") % 17
    chosen = (F.when(m == 3, F.concat("items", "items")).when(m == 4, F.concat("items", F.array(F.lit("review_word_99"))))
              .when(m == 5, F.array().cast("array<string>")).otherwise(F.col("items")))
    intro = F.when(m == 2, "praise").otherwise(F.get("intros", F.lit(0)))
    js = F.to_json(F.struct(intro.alias("intro_id"), chosen.alias("item_ids")))
    js = (F.when(m == 0, "I choose the first").when(m == 1, F.to_json(F.struct(intro.alias("intro_id"), chosen.alias("item_ids"), F.lit("x").alias("why"))))
          .when(m == 6, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js))
    return fb.choice_check(e.withColumn("choice", js), "choice", "intros", "items").select("event", "reason")


# --- streaming and hook ----------------------------------------------------------------------------

@query("stream_score", f"""WITH {SCORED_ALL_SQL}, p AS (SELECT method, event, idx // 2 AS word, diagnostic AS assessed, 1 / (1 + exp(-(CASE method WHEN 'alpha' THEN 0.05::DOUBLE WHEN 'beta' THEN 0.04::DOUBLE ELSE 0.06::DOUBLE END * score - 3))) >= 0.5 AS flagged FROM scored_all),
r AS (SELECT method, event, word, count(*) n_positions, count(*) FILTER (WHERE assessed) n_assessed, count(*) FILTER (WHERE assessed AND flagged) n_review FROM p GROUP BY ALL)
SELECT *, CASE WHEN n_review > 0 THEN 'review' WHEN n_assessed < n_positions THEN 'unassessed' ELSE 'no_flag' END status FROM r""")
def stream_score(spark, sf_dir):
    """The scored positions arrive as files of a stream; the result equals the batch answer."""
    src, out, ck = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    pos = with_methods(tokens(spark, sf_dir)).select("method", "event", "idx", F.expr("idx div 2").alias("word"), F.col("diagnostic").alias("assessed"), "score")
    pos.repartition(6, "event").write.parquet(src)
    calibration = spark.createDataFrame([("alpha", 0.05, -3.0), ("beta", 0.04, -3.0), ("gamma", 0.06, -3.0)], "method string, slope double, intercept double")
    on.stream_words(on.read_files(spark, src, pos.schema), calibration, out, ck).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """A third of the ids arrives twice, the second time later; every id is accepted once."""
    src, out, ck = (scratch(spark, n) for n in ("dedup-in", "dedup-out", "dedup-ck"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    again = e.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    e.unionByName(again).repartition(4).write.parquet(src)
    on.accept_once(on.read_files(spark, src, e.schema), "event_id", "ts", "60 days", out, ck).awaitTermination()
    return spark.read.schema(e.schema).parquet(out).select("event_id", "user_id", "event_type")


def letters(texts):
    """A toy mapper: known letters become symbols, digits are reported as unknown."""
    symbols = [[c.upper() for c in t if c.isascii() and c.isalpha()] for t in texts]
    return symbols, [[c for c in t if c.isdigit()] for t in texts]


@query("udf_hook", r"""SELECT conv_id, turn, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) n_symbols, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) n_unknown FROM conversations""")
def udf_hook(spark, sf_dir):
    c = map_texts(table(spark, sf_dir, "conversations"), "text", letters)
    return c.select("conv_id", "turn", F.size("symbols").cast("long").alias("n_symbols"), F.size("unknown").cast("long").alias("n_unknown"))
