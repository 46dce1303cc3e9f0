"""Domain tables derived row by row from the given tables, with the same rules in SQL.

``tokens``: one reference position per row (recording = 8 consecutive ids, so a recording
is bounded by construction); ``scored``: tokens stacked with three scoring methods.
Group g11 deliberately holds over a third of all recordings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The symbol inventory of the event tables, in id order 1..5.
SYMBOLS = ("click", "error", "purchase", "signup", "view")
METHODS = ("alpha", "beta", "gamma")
P_SCALE = 140.0
THRESHOLD = 0.55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = F.array(*[F.lit(s) for s in SYMBOLS])
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"),
        F.expr("event_id div 8").alias("event"),
        (F.col("event_id") % 8).alias("idx"),
        F.col("event_type").alias("target"),
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )
    alt = F.element_at(inventory, (F.col("k") / 20).cast("int") + 1)
    e = e.withColumns({
        "alt": alt,
        "target_id": F.array_position(inventory, F.col("target")).cast("long"),
        "gold_event": F.when(F.col("k") % 10 == 0, "deletion")
        .when((F.col("k") % 10).isin(1, 2, 3) & (alt != F.col("target")), "substitution")
        .otherwise("match"),
        "grp": F.concat(F.lit("g"), F.lpad(F.least(F.col("event") % 18, F.lit(11)).cast("string"), 2, "0")),
    })
    return e.withColumns({
        "realized": F.when(F.col("gold_event") == "deletion", F.lit(None))
        .when(F.col("gold_event") == "substitution", F.col("alt"))
        .otherwise(F.col("target")),
        "gold_error": (F.col("gold_event") != "match").cast("int"),
        "cohort": F.when(F.col("grp") < "g08", "case").otherwise("control"),
        "stable_event": F.col("key") % 7 != 0,
        "stable_error": (F.col("key") % 7 != 0) | (F.col("key") % 3 != 0),
        "diagnostic": F.col("key") % 17 != 0,
        "quality": F.when(F.col("event") % 23 == 0, "review"),
    })


TOKENS_SQL = """
tok0 AS (SELECT event_id AS key, event_id // 8 AS event, event_id % 8 AS idx, event_type AS target, value,
   CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
   ['click','error','purchase','signup','view'] AS inv FROM events),
tok1 AS (SELECT *, inv[CAST(k // 20 AS INT) + 1] AS alt, CAST(list_position(inv, target) AS BIGINT) AS target_id,
   'g' || lpad(CAST(least(event % 18, 11) AS VARCHAR), 2, '0') AS grp FROM tok0),
tok2 AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'deletion' WHEN k % 10 IN (1,2,3) AND alt <> target
   THEN 'substitution' ELSE 'match' END AS gold_event FROM tok1),
tokens AS (SELECT *, CASE gold_event WHEN 'deletion' THEN NULL WHEN 'substitution' THEN alt ELSE target END AS realized,
   CAST(gold_event <> 'match' AS INT) AS gold_error,
   CASE WHEN grp < 'g08' THEN 'case' ELSE 'control' END AS cohort,
   key % 7 <> 0 AS stable_event, (key % 7 <> 0 OR key % 3 <> 0) AS stable_error, key % 17 <> 0 AS diagnostic,
   CASE WHEN event % 23 = 0 THEN 'review' END AS quality FROM tok2)"""


def with_methods(tok: DataFrame) -> DataFrame:
    """Stack the three scoring methods on the positions (one pass, no join)."""
    err = F.col("gold_error")
    raw = {
        "alpha": ((F.col("key") * 37 + F.col("k") * 11) % 97 + err * 30).cast("double"),
        "beta": ((F.col("key") * 53 + F.col("k") * 7) % 97 + err * 18).cast("double"),
        "gamma": F.least(F.col("value"), F.lit(97.0)) + err * 30,
    }
    stacked = tok.select("*", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(i).alias("mi"), raw[m].alias("score"))
        for i, m in enumerate(METHODS)
    ])).alias("_m")).select("*", "_m.*").drop("_m")
    inventory = F.array(*[F.lit(s) for s in SYMBOLS])
    helped = (F.col("key") % 2 == 0) & (err == 1)
    code = (F.col("key") + F.col("mi")) % 5
    stacked = stacked.withColumns({
        "gop": -F.col("score") / 10,
        "p_error": (F.col("score") + 1) / P_SCALE,
        "cand_event": F.when(helped, F.col("gold_event")).when(code == 0, "deletion")
        .when(code == 1, "unspecified").otherwise("substitution"),
        "cand_conf": (F.col("key") * 13 + F.col("k") + F.col("mi")) % 101 / 100.0,
        "cand_margin": F.col("key") * 29 % 61 / 100.0,
    })
    predicted = F.col("p_error") >= THRESHOLD
    shifted = F.element_at(inventory, ((F.col("k") / 20).cast("int") + 1) % 5 + 1)
    return stacked.withColumns({
        "predicted": predicted,
        "cand_symbol": F.when(F.col("cand_event") == "substitution", F.when(helped, F.col("realized")).otherwise(shifted)),
        "authorized": predicted & F.col("cand_event").isin("substitution", "deletion")
        & (F.col("cand_conf") >= 0.5) & (F.col("cand_margin") >= 0.1),
    }).drop("mi")


SCORED_ALL_SQL = TOKENS_SQL + """,
scored0 AS (SELECT t.*, m.method, m.mi, CASE m.method
   WHEN 'alpha' THEN CAST((key * 37 + k * 11) % 97 + gold_error * 30 AS DOUBLE)
   WHEN 'beta' THEN CAST((key * 53 + k * 7) % 97 + gold_error * 18 AS DOUBLE)
   ELSE least(value, 97.0) + gold_error * 30 END AS score
   FROM tokens t, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) m(method, mi)),
scored1 AS (SELECT *, -score / 10 AS gop, (score + 1) / 140.0 AS p_error,
   CASE WHEN key % 2 = 0 AND gold_error = 1 THEN gold_event WHEN (key + mi) % 5 = 0 THEN 'deletion'
        WHEN (key + mi) % 5 = 1 THEN 'unspecified' ELSE 'substitution' END AS cand_event,
   (key * 13 + k + mi) % 101 / 100.0::DOUBLE AS cand_conf, key * 29 % 61 / 100.0::DOUBLE AS cand_margin FROM scored0),
scored_all AS (SELECT *, p_error >= 0.55 AS predicted,
   CASE WHEN cand_event = 'substitution' THEN CASE WHEN key % 2 = 0 AND gold_error = 1 THEN realized
        ELSE inv[(CAST(k // 20 AS INT) + 1) % 5 + 1] END END AS cand_symbol,
   (p_error >= 0.55 AND cand_event IN ('substitution', 'deletion') AND cand_conf >= 0.5 AND cand_margin >= 0.1)
     AS authorized FROM scored1)"""


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("quality").isNull() & F.col("diagnostic") & F.col("stable_error"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable positions only: quality passed, diagnostic, binary label stable."""
    return with_methods(usable(tokens(spark, sf_dir)))


SCORED_SQL = SCORED_ALL_SQL + """,
scored AS (SELECT * FROM scored_all WHERE quality IS NULL AND diagnostic AND stable_error)"""


# --- positions over the 39-phone inventory -------------------------------------------------

def phone_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tokens`` with phone symbols; a few phones are common, one is rare, many never occur."""
    from strophe.functions.inventory import phone_name

    t = tokens(spark, sf_dir)
    pid = F.when(F.col("key") % 1009 == 0, 39).otherwise((F.col("key") * F.col("key")) % 39 + 1).cast("int")
    t = t.withColumn("pid", pid).withColumn("rid", ((F.col("pid") + F.col("k") % 5) % 39 + 1).cast("int"))
    return t.withColumns({
        "target": phone_name(F.col("pid")),
        "realized": F.when(F.col("gold_event") == "match", phone_name(F.col("pid")))
        .when(F.col("gold_event") == "substitution", phone_name(F.col("rid"))),
    })


PHONES_SQL = ("['AA','AE','AH','AO','AW','AY','B','CH','D','DH','EH','ER','EY','F','G','HH','IH','IY','JH','K','L','M','N','NG',"
              "'OW','OY','P','R','S','SH','T','TH','UH','UW','V','W','Y','Z','ZH']")
PTOK_SQL = TOKENS_SQL + f""",
ptok0 AS (SELECT * EXCLUDE (target, realized), {PHONES_SQL} AS nm,
  CASE WHEN key % 1009 = 0 THEN 39 ELSE (key * key) % 39 + 1 END AS pid FROM tokens),
ptok AS (SELECT *, nm[pid] AS target, (pid + k % 5) % 39 + 1 AS rid,
  CASE gold_event WHEN 'match' THEN nm[pid] WHEN 'substitution' THEN nm[(pid + k % 5) % 39 + 1] END AS realized FROM ptok0),
conf AS (SELECT grp, cohort, target AS source, CASE gold_event WHEN 'match' THEN 'OK' WHEN 'substitution' THEN 'SUB' ELSE 'DEL' END op,
  CASE gold_event WHEN 'deletion' THEN '<DEL>' ELSE realized END alternative, count(*) n FROM ptok
  WHERE quality IS NULL AND diagnostic AND stable_event GROUP BY ALL),
phones AS (SELECT unnest({PHONES_SQL}) AS phone)"""


# --- frames --------------------------------------------------------------------------------

#: All classes of a frame vector; class 0 is the blank.
N_CLASSES = 64


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame table from the embeddings: ten frames per event, class 0 is the blank."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform("embedding", lambda v: v.cast("double") * 10)
    return e.select(F.expr("vec_id div 10").alias("event"), (F.col("vec_id") % 10).alias("frame"), "label", logits.alias("logits"))


FRAMES_SQL = """
fr AS (SELECT vec_id // 10 AS event, vec_id % 10 AS frame, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS logits FROM embeddings),
fl AS (SELECT event, frame, label, unnest(logits) AS v, unnest(generate_series(0, 63)) AS symbol FROM fr),
fm AS (SELECT *, max(v) OVER (PARTITION BY event, frame) AS mx FROM fl),
lp AS (SELECT event, frame, label, symbol, v - mx - ln(sum(exp(v - mx)) OVER (PARTITION BY event, frame)) AS logp FROM fm)"""
