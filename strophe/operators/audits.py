"""Counting and audit aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if, ratio
from strophe.operators.prefix import running_totals

USABLE_BINARY = "quality IS NULL AND diagnostic AND stable_error"


def quality_flags(events: DataFrame, sources: DataFrame, pairing: DataFrame, on: Sequence[str]) -> DataFrame:
    """One exclusion reason per event: integrity failure, else unpaired closure, else null.

    ``events`` carries ``stored`` (sequence as stored) and ``stem``; ``sources`` carries
    ``stem_seen`` and ``recomputed``; ``pairing`` is the output of ``adjacent_pairing``.
    """
    on = list(on)
    open_closures = pairing.groupBy(*on).agg(
        F.count(F.lit(1)).alias("closures"), count_if(~F.col("paired")).alias("unpaired"))
    out = events.join(sources.withColumn("_found", F.lit(True)), on, "left").join(open_closures, on, "left")
    broken = F.col("_found").isNull() | ~F.coalesce(
        (F.lower("stem") == F.lower("stem_seen")) & (F.col("stored") == F.col("recomputed")), F.lit(False))
    return out.select(
        *on, F.coalesce("closures", F.lit(0)).alias("closures"), F.coalesce("unpaired", F.lit(0)).alias("unpaired"),
        F.when(broken, "source_integrity_failure")
        .when(F.coalesce("unpaired", F.lit(0)) > 0, "unpaired_or_nonmatching_closure_release").alias("quality"))


def coverage_counts(tokens: DataFrame, by: Sequence[str], variants: Column) -> DataFrame:
    """Events, usable events, positions and label-stability counts per group.

    Events are counted through an event-level pre-aggregate instead of distinct counts.
    """
    ok = F.col("quality").isNull()
    stable = ok & F.col("diagnostic") & F.col("stable_error")
    per_event = tokens.groupBy(*by, "event").agg(
        F.max(ok.cast("int")).alias("usable"),
        F.count(F.lit(1)).alias("positions"),
        count_if(stable).alias("detection_positions"),
        count_if(ok & F.col("diagnostic") & F.col("stable_event")).alias("exact_positions"),
        count_if(stable & (F.col("gold_error") == 1)).alias("errors"),
        count_if(ok & variants).alias("variant_positions"))
    return per_event.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.sum("usable").alias("usable_events"),
        *[F.sum(c).alias(c) for c in ("positions", "detection_positions", "exact_positions", "errors", "variant_positions")])


def manifest_audit(tokens: DataFrame, text: str, sequence: str, minimum: float = 0.80) -> DataFrame:
    """Whole-table totals, distinct texts and sequences, stable shares, eligibility flag."""
    case = F.col("cohort") == "case"
    out = tokens.agg(
        F.sum("n_positions").alias("positions"), F.sum("n_stable").alias("stable_positions"), F.count(F.lit(1)).alias("events"),
        F.count_distinct(text).alias("distinct_texts"), F.count_distinct(sequence).alias("distinct_sequences"),
        F.sum(F.when(case, F.col("n_positions")).otherwise(0)).alias("case_positions"),
        F.sum(F.when(case, F.col("n_stable")).otherwise(0)).alias("case_stable"))
    out = out.withColumns({
        "stable_fraction": ratio(F.col("stable_positions"), F.col("positions")),
        "case_stable_fraction": ratio(F.col("case_stable"), F.col("case_positions"))})
    return out.withColumn("eligible", F.coalesce(F.col("case_stable_fraction") >= minimum, F.lit(False)))


def exclusion_report(kept: DataFrame, excluded: DataFrame, group: str, reasons: Sequence[str]) -> DataFrame:
    """Exclusions by reason per group and coverage = kept / (kept + excluded)."""
    rows = kept.select(group, F.lit(None).cast("string").alias("reason")).unionByName(excluded.select(group, "reason"))
    out = rows.groupBy(group).agg(
        count_if(F.col("reason").isNull()).alias("kept"), count_if(F.col("reason").isNotNull()).alias("excluded"),
        *[count_if(F.col("reason") == r).alias(f"excluded_{r}") for r in reasons])
    return out.withColumn("coverage", ratio(F.col("kept"), F.col("kept") + F.col("excluded")))


def symbol_counts(rows: DataFrame, symbols: str, inventory: DataFrame, name: str) -> DataFrame:
    """Counts over the whole inventory, zeros included."""
    counts = rows.select(F.explode(symbols).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return inventory.select(name).join(counts, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_counts(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """(source, operation, alternative) counts over stable diagnostic positions."""
    op = F.when(F.col("gold_event") == "match", "OK").when(F.col("gold_event") == "substitution", "SUB").otherwise("DEL")
    alt = (F.when(F.col("gold_event") == "match", F.col("target"))
           .when(F.col("gold_event") == "substitution", F.col("realized")).otherwise("<DEL>"))
    use = tokens.where("quality IS NULL AND diagnostic AND stable_event")
    return use.groupBy(*by, F.col("target").alias("source"), op.alias("op"), alt.alias("alternative")).agg(
        F.count(F.lit(1)).alias("n"))


def gap_length_counts(gaps: DataFrame, by: Sequence[str], cap: int = 2) -> DataFrame:
    """Gaps by status, with how many are over the insertion cap and by how much."""
    n = F.size("inserted")
    status = (F.when(F.col("quality").isNotNull(), "quality_excluded").when(~F.col("diagnostic"), "nondiagnostic")
              .when(~F.col("stable"), "alignment_uncertain").otherwise(F.concat(F.lit("stable_length_"), n.cast("string"))))
    counted = F.col("status").startswith("stable")
    return gaps.withColumn("status", status).groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("gaps"),
        F.sum(F.when(counted, n).otherwise(0)).alias("inserted_symbols"),
        count_if(counted & (n > cap)).alias("over_cap"),
        F.sum(F.when(counted, F.greatest(n - cap, F.lit(0))).otherwise(0)).alias("over_cap_extra"))


def table_fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row count and order-independent content digest, of the whole table or of every part ``by`` some columns.

    Row digests are combined with sums and xors, which merge map-side; no list of rows is
    ever gathered. Duplicated rows change the sum and the count.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols])
    digest = F.md5(row)
    high = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")
    out = df.select(*by, high.alias("h"), low.alias("l")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("sh"), F.bit_xor("h").alias("xh"),
        F.sum(F.col("l").cast("decimal(38,0)")).alias("sl"), F.bit_xor("l").alias("xl"))
    parts = [F.col(c).cast("string") for c in ("n_rows", "sh", "xh", "sl", "xl")]
    return out.select(*by, "n_rows", F.md5(F.concat_ws("|", *parts)).alias("fingerprint"))


def group_summary(positions: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Per event and symbol: flagged, assessed, unassessed and the flagged words with repetitions."""
    hit = F.col("assessed") & F.col("flagged")
    listed = F.array_sort(F.collect_list(F.when(hit, F.struct(F.col(order).alias("o"), F.col("word").alias("w")))))
    return positions.groupBy(*by).agg(
        count_if(hit).alias("flagged"), count_if(F.col("assessed")).alias("assessed"),
        count_if(~F.col("assessed")).alias("unassessed"), F.transform(listed, lambda x: x["w"]).alias("flagged_words"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] | int) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size: (by, prob, value).

    ``probs`` is a short list, or a number of evenly spaced points from 0 to 1. Ranks come from
    running totals over distinct values, so no task holds a group; a cell is unfolded only for
    the probabilities whose neighbouring ranks it covers.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(cells, by, value, ["n"], descending=False)
    before, last = F.col("cum_n") - F.col("n"), F.col("tot_n") - 1
    if isinstance(probs, int):
        steps = float(probs - 1)
        at = lambda r: r * steps / F.greatest(last, F.lit(1))
        lo = F.greatest(F.floor(at(before - 1)) - 1, F.lit(0)).cast("int")
        hi = F.least(F.ceil(at(F.col("cum_n"))) + 1, F.lit(probs - 1)).cast("int")
        grid = F.transform(F.sequence(lo, hi), lambda i: i / steps)
    else:
        grid = F.array(*[F.lit(float(p)) for p in probs])

    def covers(i: Column) -> Column:
        return (before <= i) & (i < F.col("cum_n"))

    hits = F.filter(grid, lambda p: covers(F.floor(p * last)) | covers(F.ceil(p * last)))
    rows = run.select(*by, value, before.alias("_b"), "cum_n", last.alias("_l"), F.explode(hits).alias("prob"))
    pos = F.col("prob") * F.col("_l")
    pick = lambda i: F.max(F.when((F.col("_b") <= i) & (i < F.col("cum_n")), F.col(value)))
    out = rows.groupBy(*by, "prob").agg(pick(F.floor(pos)).alias("_lo"), pick(F.ceil(pos)).alias("_hi"), F.max(pos).alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return out.select(*by, "prob", (F.col("_lo") + part * (F.col("_hi") - F.col("_lo"))).alias("value"))


def check_pass_rates(df: DataFrame, by: Sequence[str], checks: Sequence[str]) -> DataFrame:
    """Passes per named boolean check and stratum; a missing check is not counted."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in checks]))
    long = df.select(*by, cells.alias("_c")).select(*by, "_c.*").where("ok IS NOT NULL")
    return long.groupBy(*by, "check").agg(count_if(F.col("ok")).alias("passed"), F.count(F.lit(1)).alias("n"))


def paired_both_correct(df: DataFrame, key: str, partner: str, success: str) -> DataFrame:
    """Pairs where a row and its declared partner both succeed."""
    other = df.select(F.col(key).alias("_k"), F.col(success).alias("_ok"))
    both = df.where(F.col(partner).isNotNull()).join(other, F.col(partner) == F.col("_k"))
    return both.agg(count_if(F.col(success) & F.col("_ok")).alias("both_correct"), F.count(F.lit(1)).alias("n_pairs"))
