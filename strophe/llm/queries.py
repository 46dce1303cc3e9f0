"""The registered queries of this subpackage and their SQL; the digest columns are derived here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


AZ_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {AZ_SQL.format(f"trim(line, {BLANKS_SQL})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.line_dedup import drop_shared_lines

    out = drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _rules_sql() -> str:
    from strophe.llm.quality_rules import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rule = lambda name, broken, words: f"CASE WHEN n_words >= {words} AND ({broken}) THEN '{name}' END"
    failed = ", ".join((
        rule("mean_word_chars", "word_chars / n_words < 2 OR word_chars / n_words > 14", 20), rule("symbols_per_word", "n_symbols / n_words > 0.25::DOUBLE", 20),
        rule("stop_word_share", "n_stop / n_words < 0.01::DOUBLE", 50), rule("duplicate_line_share", "n_dup_lines / n_full_lines > 0.5", 20),
        rule("words_with_letter_share", "n_letter_words / n_words < 0.6::DOUBLE", 20), rule("ellipsis_line_share", "n_ellipsis_lines / n_full_lines > 0.5", 20)))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (SELECT unnest(generate_series(0, 4)) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
f AS (SELECT doc_id, count(*) AS n_full_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
  count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*\z')) AS n_ellipsis_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: {AZ_SQL.format("x")} IN ({stop}))) AS BIGINT) AS n_stop,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words,
  coalesce(n_full_lines, 0) AS n_full_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM b"""


@query(_rules_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.quality_rules import judged

    return judged(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


WORDS_SQL = "regexp_extract_all(" + AZ_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+')"


@query(f"""
WITH dw AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT *, least(13, len(w)) AS size, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iwin),
dwin AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, s, d.size FROM dwin d JOIN iwin i ON d.size = i.size AND d.g = i.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode and decode by the public rank file; digests of ids and bytes."""
    import public_tokenizers

    from strophe.llm.bpe import encoded

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encoded(docs, path, public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS owner,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to FROM d""")
def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.common import scratch
    from strophe.llm.warc import read_bundles, write_bundles

    pages = table(spark, sf_dir, "pages")
    root = scratch(spark, "bundles")
    records = read_bundles(spark, write_bundles(pages, root), root, with_payload=False)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({AZ_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.part_enum import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op10_hpy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.common import crc_mod
    from strophe.llm.hpy import scored, train

    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs.where(crc_mod(F.col("doc_id"), 7) != 2)))
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.common import crc_mod
    from strophe.llm.language_id import identified, trained

    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    return identified(docs, trained(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query()
def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.cotrain import scored, trained

    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.personal_data import BASE, personal_data

    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _resampling_sql() -> str:
    """Bucket counts, gains and scores; crc32 goes by a table of 256 steps of its polynomial."""
    words = lambda t: f"SELECT unnest({WORDS_SQL}) AS w FROM {t}"
    return f"""
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
dw AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), iw AS ({words("benchmark")}),
one AS (SELECT doc_id, unnest(ws) AS w FROM dw),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM one UNION SELECT w FROM iw)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS b FROM vocabulary),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS k FROM bytes, poly),
s AS (SELECT k, count(*) AS n FROM one JOIN bucket USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM iw JOIN bucket USING (w) GROUP BY k),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all),
gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), a),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM one JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g::DOUBLE / n) AS BIGINT), 0) AS weight, h FROM dw LEFT JOIN f USING (doc_id) JOIN h USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS k FROM c WHERE n_features >= 20)
SELECT c.*, CASE WHEN rank <= k THEN rank END AS rank FROM c LEFT JOIN o USING (doc_id)"""


@query(_resampling_sql())
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.resampling import resampled

    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def _license_sql() -> str:
    """Every rule of the table by keyword, places by running word counts, then suppression by the furthest end so far."""
    from strophe.llm.license_rules import CONFIDENCE, RULES, compiled

    table_ = ", ".join(f"({i}, '{r.label}', {r.tier}, '{r.keyword}', '{compiled(r.pattern)}', {r.base})" for i, r in enumerate(RULES))
    reach = " ".join(f"WHEN {t} THEN max(CASE WHEN tier <= {t} THEN e ELSE -1 END) OVER w" for t in range(len(CONFIDENCE)))
    sure = " ".join(f"WHEN {t} THEN {c}::DOUBLE" for t, c in enumerate(CONFIDENCE))
    return f"""
WITH rules(num, label, tier, keyword, pattern, base) AS (VALUES {table_}),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
n AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS n FROM d WHERE list_has_any(w, (SELECT list(DISTINCT keyword) FROM rules))),
m AS (SELECT doc_id, num, label, tier, base, regexp_extract_all(n, pattern) AS hits, string_split_regex(n, pattern) AS pieces FROM n JOIN rules ON list_contains(w, keyword)),
u AS (SELECT doc_id, num, label, tier, base, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, generate_subscripts(hits, 1) AS i FROM m WHERE len(hits) > 0),
z AS (SELECT *, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS k, (length(piece) - length(replace(piece, ' ', ''))) // 2 AS p FROM u),
x AS (SELECT *, sum(p + k) OVER (PARTITION BY doc_id, num ORDER BY i) - k AS s FROM z),
y AS (SELECT doc_id, num, label, tier, base, CAST(s AS BIGINT) AS s, CAST(s + k AS BIGINT) AS e FROM x),
q AS (SELECT *, coalesce(CASE tier {reach} END, -1) AS far FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY s, e DESC, tier, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (base OR far < e)), ',') AS labels,
  CASE min(tier) FILTER (far < e) {sure} END AS score FROM q GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN g USING (doc_id)"""


@query(_license_sql())
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.licenses import licensed

    out = licensed(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda m: m["start"].cast("long"))
    names = F.array_sort(F.array_distinct(F.transform("base", lambda m: m["label"])))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      F.array_join(names, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strophe.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
