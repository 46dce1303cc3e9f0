"""Which dictionary variants of a word may be accepted at a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.inventory import HOMOGRAPHS, PROJECTION, WEAK_PAIRS, literal_map


def model_symbols(symbols):
    """Stress digits removed, intermediate symbols folded."""
    bare = lambda s: F.regexp_replace(F.upper(s), "[012]$", "")
    return F.transform(symbols, lambda s: F.coalesce(F.element_at(literal_map(PROJECTION), bare(s)), bare(s)))


def variant_positions(lexicon: DataFrame, weak_pairs: Sequence[tuple[str, str]] = WEAK_PAIRS, blocked: Sequence[str] | Column = HOMOGRAPHS) -> DataFrame:
    """One row per word: base symbols, accepted symbols per position, diagnostic flag, reasons.

    A variant counts only with the same length, exactly one differing position and a listed
    pair; anything else makes the whole word non-diagnostic. Two different changed positions
    reject all variants. A word has few variants, so they are gathered into one row.
    """
    rows = F.array_sort(F.collect_list(F.struct("variant", "symbols")))
    w = lexicon.groupBy("word").agg(rows.alias("_v")).withColumn("_base", F.get("_v", F.lit(0))["symbols"])
    block = blocked if isinstance(blocked, Column) else F.col("word").isin(list(blocked))

    def judge(v):
        s = v["symbols"]
        diff = F.filter(F.transform(F.sequence(F.lit(0), F.size("_base") - 1), lambda i: F.when(F.get("_base", i) != F.get(s, i), i)), lambda x: x.isNotNull())
        same_length = F.size(s) == F.size("_base")
        at = F.get(diff, F.lit(0))
        a, b = F.get(F.col("_base"), at), F.get(s, at)
        listed = F.lit(False)
        for x, y in weak_pairs:
            listed = listed | ((a == x) & (b == y)) | ((a == y) & (b == x))
        equal = model_symbols(s) == model_symbols(F.col("_base"))
        good = ~block & same_length & (F.size(diff) == 1) & F.coalesce(listed, F.lit(False))
        reason = (F.when(equal | good, None).when(block, "context_ambiguous_homograph")
                  .when(~same_length, "length_changing_variant_unavailable").otherwise("unsupported_lexical_variant_unavailable"))
        return F.struct(F.when(good & ~equal, at).alias("at"), F.when(good & ~equal, F.get(model_symbols(s), at)).alias("symbol"), reason.alias("reason"))

    w = w.withColumn("_j", F.transform(F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))), judge))
    changed = F.array_distinct(F.filter(F.transform("_j", lambda j: j["at"]), lambda a: a.isNotNull()))
    many = F.size(changed) > 1
    reasons = F.filter(F.concat(F.transform("_j", lambda j: j["reason"]), F.array(
        F.when(many, "multiple_variant_positions_would_invent_combinations"), F.when(block, "context_ambiguous_homograph"))), lambda r: r.isNotNull())
    accepted = F.transform(model_symbols(F.col("_base")), lambda s, i: F.array_distinct(F.concat(F.array(s), F.when(many, F.array().cast("array<string>")).otherwise(
        F.transform(F.filter("_j", lambda j: j["at"] == i), lambda j: j["symbol"])))))
    out = w.select("word", F.col("_base").alias("source_symbols"), accepted.alias("accepted"), F.array_sort(F.array_distinct(reasons)).alias("reasons"),
                   F.size("_v").alias("n_variants"))
    return out.withColumns({
        "diagnostic": F.size("reasons") == 0,
        "variant_positions": F.size(F.filter("accepted", lambda a: F.size(a) > 1))})
