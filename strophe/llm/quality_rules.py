"""A threshold table of text ratios compiled into one projection (no user functions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import BLANKS, WORD_GAP, let

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "was", "at", "by", "be", "it",
              "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht",
              "de", "la", "le", "les", "et", "que", "des", "un", "une", "en", "du", "est", "pour", "dans",
              "el", "los", "y", "las", "se", "por", "con", "su", "al", "es")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio has to lie in [low, high]; documents under ``from_words`` words are not judged by it."""

    name: str
    ratio: Column
    low: float | None = None
    high: float | None = None
    from_words: int = 1

    def holds(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (self.ratio >= self.low)
        if self.high is not None:
            ok = ok & (self.ratio <= self.high)
        return F.when(F.col("n_words") < self.from_words, F.lit(True)).otherwise(F.coalesce(ok, F.lit(True)))


def default_rules() -> tuple[Rule, ...]:
    """The threshold table. Documents of few words are judged by length and repetition alone."""
    c = F.col
    return (
        Rule("mean_word_chars", c("word_chars") / c("n_words"), 2.0, 14.0, 20),
        Rule("symbols_per_word", c("n_symbols") / c("n_words"), None, 0.25, 20),
        Rule("stop_word_share", c("n_stop") / c("n_words"), 0.01, None, 50),
        Rule("duplicate_line_share", c("n_dup_lines") / c("n_full_lines"), None, 0.5, 20),
        Rule("words_with_letter_share", c("n_letter_words") / c("n_words"), 0.6, None, 20),
        Rule("ellipsis_line_share", c("n_ellipsis_lines") / c("n_full_lines"), None, 0.5, 20),
    )


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the array, first occurrences included.

    Windows are compared by a 64-bit hash within one text. Sorting (hash, position) finds the
    repeats in n log n steps however repetitive the text; texts without any skip it.
    """
    def hashes(w):
        return F.when(F.size(w) >= window, F.transform(
            F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])))

    def positions(s):
        def again(x, k):
            return (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def covered(p):
        widths = F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, v: a + v)

    def count(h):
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), lambda s: let(positions(s), covered)))

    return F.coalesce(let(hashes(words), count), F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts behind the ratios of every whole text (null: no words)."""
    trimmed = F.btrim("text", F.lit(BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_w", words)
    full = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    stop = "(?<![^\\x20\\x09-\\x0D])(?i:" + "|".join(dict.fromkeys(STOP_WORDS)) + ")(?![^\\x20\\x09-\\x0D])"
    counts = let(full, lambda ls: F.struct(
        F.size(ls).alias("full"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"),
        F.size(F.filter(ls, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"))).alias("ellipsis")))
    m = d.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), counts.alias("_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"), F.regexp_count("text", F.lit(stop)).cast("long").alias("n_stop"),
        F.size(F.filter("_w", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("_lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        "n_stop", "n_letter_words", F.col("_lines.full").cast("long").alias("n_full_lines"),
        F.col("_lines.ellipsis").cast("long").alias("n_ellipsis_lines"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] | None = None, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, failed_rules and kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` percent of the words in
    repeated windows. kept: neither that nor any rule of the table failed. Null and empty texts
    have no words and fail. Ids are not looked at; repeated rows and ties are judged alike, and
    other columns of ``docs`` are ignored.
    """
    rules = default_rules() if rules is None else rules
    m = measured(docs)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return m.select("*", base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
