"""Feedback tables, fixed sentences and checks of texts against counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if


def word_rollup(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Word status: any review -> review, else any unassessed -> unassessed, else no_flag.

    Positions carry ``assessed`` and ``flagged``; counts make up the totals of an event.
    """
    review = F.col("assessed") & F.col("flagged")
    out = positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_positions"), count_if(F.col("assessed")).alias("n_assessed"), count_if(review).alias("n_review"))
    return out.withColumn("status", F.when(F.col("n_review") > 0, "review")
                          .when(F.col("n_assessed") < F.col("n_positions"), "unassessed").otherwise("no_flag"))


def review_topk(positions: DataFrame, event: str, word: str, k: int = 3) -> DataFrame:
    """At most ``k`` words per event by (-largest p, word index), with distinct targets in order."""
    hit = positions.where(F.col("assessed") & F.col("flagged"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "target"))), lambda x: x["target"])
    words = hit.groupBy(event, word).agg(F.max("p_error").alias("p_max"), F.array_distinct(listed).alias("targets"))
    w = Window.partitionBy(event).orderBy(F.desc("p_max"), word)
    return words.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# The sentences of the feedback text.
FLAGGED = ("The model flagged %d of %d assessed target sounds across %d word(s) for review. A flag suggests a place to "
           "listen again; it does not establish a specific pronunciation error.")
CLEAR = ("No positions were flagged among %d assessed target sounds. This does not establish that every sound was correct. "
         "You can replay the full recording and try the practice text again.")
NOTHING = ("There were no assessed target sounds. No pronunciation judgment is available. "
           "You can replay the full recording or choose another practice text.")
COVERAGE = "%d target sound(s) were not assessed."
UNASSESSED = " Unassessed words: %s."
FOCUS = " This message focuses on %d of the flagged words."
ITEM = "Review word %d, %s, paying attention to the target sound(s) %s. Replay the full recording, then try the practice text again if you wish."


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


def render_summary(events: DataFrame) -> DataFrame:
    """Adds ``intro_id`` and ``text``: fixed sentences from the counts of an event; nothing is invented.

    Needs ``n_assessed, n_review, n_unassessed, review_words``; ``unassessed`` (texts as 'word n "text"') and ``n_items`` (review items shown) are used if present.
    """
    intro = (F.when(F.col("n_review") > 0, F.format_string(FLAGGED, "n_review", "n_assessed", "review_words"))
             .when(F.col("n_assessed") > 0, F.format_string(CLEAR, "n_assessed")).otherwise(NOTHING))
    kind = F.when(F.col("n_review") > 0, "review").when(F.col("n_assessed") > 0, "no_flag").otherwise("unassessed")
    text = F.concat(intro, F.lit(" "), F.format_string(COVERAGE, "n_unassessed"))
    if "unassessed" in events.columns:
        text = F.concat(text, F.when(F.size("unassessed") > 0, F.format_string(UNASSESSED, F.array_join("unassessed", ", "))).otherwise(""))
    if "n_items" in events.columns:
        text = F.concat(text, F.when(F.col("review_words") > F.col("n_items"), F.format_string(FOCUS, "n_items")).otherwise(""))
    return events.withColumns({"intro_id": kind, "text": text})


def feedback_text(positions: DataFrame, event: str, word: str, k: int = 3) -> DataFrame:
    """(event, intro_id, text, n_items): summary, unassessed words, focus sentence and at most ``k`` review items of every recording.

    Positions carry ``idx, target, assessed, flagged, p_error`` and ``text``, the word's text (that of its first position counts). One pass makes a
    row per word; the words of a recording are few and meet in its row. Null texts are shown as an empty string.
    """
    hit = F.col("assessed") & F.col("flagged")
    targets = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("idx", "target")))), lambda x: x["target"]))
    words = positions.groupBy(event, word).agg(
        F.coalesce(F.min_by("text", "idx"), F.lit("")).alias("_text"), F.count(F.lit(1)).alias("_n"), count_if(F.col("assessed")).alias("_a"), count_if(hit).alias("_r"),
        F.max(F.when(hit, F.col("p_error"))).alias("_p"), targets.alias("_t"))
    name = quoted(F.col("_text"))
    sounds = F.array_join(F.transform("_t", lambda t: F.concat(F.lit("/"), t, F.lit("/"))), ", ")
    number = F.col(word) + 1
    item = F.when(F.col("_r") > 0, F.struct((-F.col("_p")).alias("p"), F.col(word).alias("w"), F.format_string(ITEM, number, name, sounds).alias("s")))
    gap = F.when((F.col("_r") == 0) & (F.col("_a") < F.col("_n")), F.struct(F.col(word).alias("w"), F.format_string("word %d %s", number, name).alias("s")))
    per = words.groupBy(event).agg(
        F.sum("_a").alias("n_assessed"), F.sum("_r").alias("n_review"), F.sum(F.col("_n") - F.col("_a")).alias("n_unassessed"), count_if(F.col("_r") > 0).alias("review_words"),
        F.transform(F.array_sort(F.collect_list(gap)), lambda x: x["s"]).alias("unassessed"), F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("_items"))
    out = render_summary(per.withColumn("n_items", F.size("_items")))
    shown = F.concat_ws("\n\n", F.array("text"), F.transform("_items", lambda x: x["s"]))
    return out.select(event, "intro_id", shown.alias("text"), "n_items")


def render_count_sentence(df: DataFrame, words: str) -> DataFrame:
    """The fixed one-sentence summary of a symbol: counts and the flagged words with repetitions."""
    listed = F.when(F.size(words) == 0, "none").otherwise(F.concat_ws(", ", words))
    return df.withColumn("sentence", F.format_string(
        "In this attempt, /%s/ was flagged in %d of %d assessed positions; flagged words: %s.", "target", "flagged", "assessed", listed))


# Fixed value: the pattern of the sentence above.
SENTENCE = (r"(?i)^In this attempt,\s*/([^/\s]+)/\s+was flagged in\s+(\d+)\s+of\s+(\d+)\s+assessed positions;\s*"
            r"flagged words:\s*([A-Za-z ,]+)\.?$")


def check_count_sentence(df: DataFrame, text: str, words: str) -> DataFrame:
    """Parse the fixed sentence and compare symbol, both counts and the words as a multiset."""
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    part = lambda i: F.regexp_extract(flat, SENTENCE, i)
    ok = flat.rlike(SENTENCE)
    said = F.lower(F.trim(part(4)))
    listed = F.when(said == "none", F.array().cast("array<string>")).otherwise(F.transform(F.split(said, ","), lambda w: F.trim(w)))
    checks = {
        "parseable": ok,
        "symbol_correct": ok & (part(1) == F.col("target")),
        "flagged_correct": ok & F.coalesce((part(2).try_cast("bigint") == F.col("flagged")), F.lit(False)),
        "assessed_correct": ok & F.coalesce(part(3).try_cast("bigint") == F.col("assessed"), F.lit(False)),
        "words_correct": ok & (F.array_sort(listed) == F.array_sort(F.col(words))),
    }
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return df.withColumns(checks).withColumn("success", every)


def sentence_check(df: DataFrame, text: str, targets: str, original: str, vocabulary: Sequence[str]) -> DataFrame:
    """All targets present, 5-10 words, one plain sentence, different from the original, and the
    words outside the vocabulary."""
    sentence = F.trim(F.regexp_replace(F.col(text), '^[\\s"“”]+|[\\s"“”]+$', ""))
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    said = tokens(sentence)
    body = F.regexp_replace(sentence, "[.!?]$", "")
    df = df.withColumn("_w", said)
    return df.withColumns({
        "target_coverage": F.forall(targets, lambda t: F.array_contains("_w", t)),
        "word_count_ok": F.size("_w").between(5, 10),
        "one_plain_sentence": body.rlike("^[A-Za-z ]+$"),
        "different": F.col("_w") != tokens(F.col(original)),
        "outside": F.array_sort(F.array_distinct(F.array_except("_w", F.array(*[F.lit(v) for v in vocabulary])))),
        "n_words": F.size("_w"),
    }).drop("_w").withColumn("success", F.col("target_coverage") & F.col("word_count_ok") & F.col("one_plain_sentence") & F.col("different"))


def choice_check(df: DataFrame, choice: str, allowed_intros: str, allowed_items: str, limit: int = 3) -> DataFrame:
    """A JSON choice may only hold one allowed intro and distinct allowed item ids; else a reason."""
    text = F.trim(choice)
    fenced = F.when(text.startswith("```json\n") & text.endswith("```"), F.trim(F.substring(text, F.lit(9), F.length(text) - 11))).otherwise(text)
    d = df.withColumn("_t", fenced).withColumn("_j", F.from_json("_t", "intro_id string, item_ids array<string>, _bad string",
                                                                 {"columnNameOfCorruptRecord": "_bad"}))
    keys = F.json_object_keys("_t")
    ids = F.col("_j.item_ids")
    reason = (F.when(F.col("_j._bad").isNotNull() | keys.isNull(), "not_json")
              .when(F.array_sort(keys) != F.array(F.lit("intro_id"), F.lit("item_ids")), "wrong_fields")
              .when(~F.coalesce(F.array_contains(allowed_intros, F.col("_j.intro_id")), F.lit(False)), "intro_not_allowed")
              .when(ids.isNull() | F.exists(ids, lambda i: i.isNull()), "items_not_a_list")
              .when((F.size(F.array_distinct(ids)) != F.size(ids)) | (F.size(F.array_except(ids, F.col(allowed_items))) > 0), "items_not_distinct_allowed")
              .when((F.size(ids) > limit) | ((F.size(allowed_items) > 0) & (F.size(ids) == 0)), "wrong_number_of_items"))
    return d.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_t", "_j")
