"""Metrics on which error was made: substitutions, deletions, insertions, specific output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if, harmonic_f1, ratio, ratio_or_zero
from strophe.operators.detection import (
    probability_metrics,
    ranking_metrics,
    token_metrics,
)


def correct_candidate() -> Column:
    """The proposed event is the gold event and, for a substitution, names the symbol."""
    return F.coalesce(
        (F.col("cand_event") == F.col("gold_event"))
        & ((F.col("cand_event") == "deletion") | (F.col("cand_symbol") == F.col("realized"))),
        F.lit(False),
    )


def deletion_prf(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """A deletion is predicted when p >= threshold and the top candidate is a deletion."""
    gold = F.col("gold_event") == "deletion"
    pred = (F.col("p_error") >= threshold) & (F.col("cand_event") == "deletion")
    out = df.where("stable_event").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(gold).alias("support"),
        count_if(pred).alias("n_predicted"),
        count_if(gold & pred).alias("tp"),
    )
    out = out.withColumns({
        "precision": ratio(F.col("tp"), F.col("n_predicted")),
        "recall": ratio(F.col("tp"), F.col("support")),
    })
    return out.withColumn("f1", harmonic_f1(F.col("precision"), F.col("recall")))


def diagnosis_prf(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact substitution and deletion rates plus the authorised selective statements."""
    ok = correct_candidate()
    aggs = [F.count(F.lit(1)).alias("n_exact")]
    for e, s in (("substitution", "sub"), ("deletion", "del")):
        pred = F.col("predicted") & (F.col("cand_event") == e)
        aggs += [
            count_if(F.col("gold_event") == e).alias(f"{s}_gold"),
            count_if(pred).alias(f"{s}_predicted"),
            count_if(pred & ok).alias(f"{s}_tp"),
        ]
    aggs += [count_if(F.col("authorized")).alias("n_specific"), count_if(F.col("authorized") & ok).alias("_ok")]
    out = df.where("stable_event").groupBy(*by).agg(*aggs)
    one = F.lit(1)
    for s in ("sub", "del"):
        precision = F.col(f"{s}_tp") / F.greatest(F.col(f"{s}_predicted"), one)
        recall = F.col(f"{s}_tp") / F.greatest(F.col(f"{s}_gold"), one)
        out = out.withColumns({f"{s}_precision": precision, f"{s}_recall": recall})
        out = out.withColumn(
            f"{s}_f1", 2 * F.col(f"{s}_precision") * F.col(f"{s}_recall")
            / F.greatest(F.col(f"{s}_precision") + F.col(f"{s}_recall"), F.lit(1e-12)))
    return out.withColumns({
        "specific_coverage": F.col("n_specific") / F.greatest(F.col("n_exact"), one),
        "specific_precision": ratio(F.col("_ok"), F.col("n_specific")),
    }).drop("_ok")


def specific_output(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Coverage and precision of authorised statements among predicted errors."""
    eligible = F.col("p_error") >= threshold
    allowed = eligible & F.col("authorized")
    out = df.groupBy(*by).agg(
        count_if(eligible).alias("n_error_predictions"),
        count_if(allowed).alias("n_authorized"),
        count_if(allowed & correct_candidate()).alias("n_correct"),
    )
    return out.withColumns({
        "coverage": ratio_or_zero(F.col("n_authorized"), F.col("n_error_predictions")),
        "precision": ratio(F.col("n_correct"), F.col("n_authorized")),
    })


def insertion_prf(slots: DataFrame, gaps: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Gap-slot detection: stable diagnostic gaps with at most two gold insertions."""
    gold = gaps.where(F.col("stable") & F.col("diagnostic") & (F.size("inserted") <= 2)).select(*on, "inserted")
    rows = slots.join(gold, list(on)).withColumn(
        "gold_symbol", F.get("inserted", F.col("ordinal").cast("int")))
    hit = F.col("insertion_probability") >= 0.5
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.count("gold_symbol").alias("gold_insertions"),
        count_if(hit).alias("n_positive"),
        count_if(hit & (F.col("gold_symbol") == F.col("slot_symbol"))).alias("n_correct"),
        F.avg(F.when(F.col("ordinal") == 1, hit.cast("double"))).alias("cap_hit_rate"),
    )
    one = F.lit(1)
    out = out.withColumns({
        "precision": F.col("n_correct") / F.greatest(F.col("n_positive"), one),
        "recall": F.col("n_correct") / F.greatest(F.col("gold_insertions"), one),
    })
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                          / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def rank_metrics(cands: DataFrame, by: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Top-1, top-3 and reciprocal rank of the realised symbol (stable substitutions).

    ``cands`` is long: one row per (row key, candidate) with ``prob`` and ``realized``.
    A row holds at most one inventory; its rank is a count of better candidates.
    """
    hit = F.col("candidate") == F.col("realized")
    p = F.max(F.when(hit, F.col("prob"))).over(Window.partitionBy(*row))
    rows = cands.withColumn("_p", p).where("_p IS NOT NULL")
    better = (F.col("prob") > F.col("_p")) | ((F.col("prob") == F.col("_p")) & (F.col("candidate") < F.col("realized")))
    rank = rows.groupBy(*dict.fromkeys([*by, *row])).agg((count_if(better) + 1).alias("rank"))
    return rank.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("top1"),
        F.avg((F.col("rank") <= 3).cast("double")).alias("top3"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
    )


def candidate_retention(df: DataFrame, by: Sequence[str], allowed: str, accepted: str) -> DataFrame:
    """Is the realised symbol of a stable substitution still among the kept candidates?"""
    subs = df.where(F.col("stable_event") & (F.col("gold_event") == "substitution"))
    kept = F.array_contains(F.array_union(F.col(allowed), F.col(accepted)), F.col("realized"))
    wrong = F.col("predicted").cast("int") != F.col("gold_error")
    out = subs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_substitutions"),
        count_if(kept).alias("retained"),
        count_if(~kept).alias("missing"),
        count_if(~kept & wrong).alias("missing_errors"),
        count_if(~kept & ~F.col("predicted")).alias("_fn"),
    )
    return out.withColumns({
        "retention_rate": ratio(F.col("retained"), F.col("n_substitutions")),
        "missing_error_rate": ratio(F.col("missing_errors"), F.col("missing")),
        "missing_fnr": ratio(F.col("_fn"), F.col("missing")),
    }).drop("_fn")


def strata_metrics(df: DataFrame, by: Sequence[str], fields: Sequence[str], label: str, p: str) -> DataFrame:
    """Pooled metrics inside every value of several descriptive fields; empty is skipped."""
    long = df.select("*", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stratum")) for f in fields
    ])).alias("_s")).select("*", "_s.*").where("stratum IS NOT NULL AND stratum <> ''")
    keys = [*by, "field", "stratum"]
    return ranking_metrics(long, keys, p, label).join(probability_metrics(long, keys, p, label), keys)


def accepted_variant_alarms(df: DataFrame, by: Sequence[str], accepted: str) -> DataFrame:
    """False alarms where another acceptable symbol than the reference was realised."""
    rows = df.where(
        F.col("stable_event") & (F.col("gold_event") == "match") & (F.col("realized") != F.col("target"))
        & F.array_contains(accepted, F.col("realized")))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("predicted")).alias("false_alarms"),
        F.avg(F.col("predicted").cast("double")).alias("rate"))


def subtask_ranking(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Ranking metrics with changed denominators: match plus one kind of error at a time."""
    exact = F.col("stable_event")
    tags = F.filter(F.array(
        F.lit("all"),
        F.when(exact & F.col("gold_event").isin("match", "substitution"), "match_sub"),
        F.when(exact & F.col("gold_event").isin("match", "deletion"), "match_del"),
        F.when((F.col("gold_event") == "match") | (~exact & (F.col(label) == 1)), "match_ambiguous"),
    ), lambda t: t.isNotNull())
    return ranking_metrics(df.select("*", F.explode(tags).alias("subtask")), [*by, "subtask"], score, label)


def failure_decomposition(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Where errors are lost: candidate, threshold and gate counts by gold composition."""
    kind = (F.when(F.col("stable_event"), F.col("gold_event"))
            .when(F.col("gold_error") == 1, "ambiguous_error").otherwise("ambiguous_correct"))
    good = (F.col("gold_event") == "substitution") & F.col("stable_event") & correct_candidate()
    return df.withColumn("composition", kind).groupBy(*by, "composition").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("cand_event") == "substitution").alias("cand_substitution"),
        count_if(F.col("cand_event") == "deletion").alias("cand_deletion"),
        count_if(F.col("predicted")).alias("predicted_error"),
        count_if(good).alias("correct_before_threshold"),
        count_if(good & F.col("predicted")).alias("correct_after_threshold"),
        count_if(good & F.col("authorized")).alias("correct_after_gate"),
        F.avg("p_error").alias("mean_p_error"),
    )


def evaluation_report(df: DataFrame, by: Sequence[str], group: str, label: str = "label") -> DataFrame:
    """Tidy report: (scope, group, metric, value) with per-group, macro and pooled rows."""
    metrics = ["ap", "auroc", "fpr_at_recall", "brier", "nll", "f1", "fpr", "fnr"]
    per = token_metrics(df, [*by, group], label=label)
    pooled = token_metrics(df, by, label=label)

    def tidy(t: DataFrame, scope: str, name) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
        return t.select(*by, F.lit(scope).alias("scope"), name.alias("member"), pairs.alias("_p")).select(
            *by, "scope", "member", "_p.*")

    per_long = tidy(per, "group", F.col(group))
    macro = per_long.groupBy(*by, "metric").agg(F.avg("value").alias("value")).select(
        *by, F.lit("macro").alias("scope"), F.lit("all").alias("member"), "metric", "value")
    return per_long.unionByName(macro).unionByName(tidy(pooled, "pooled", F.lit("all")))
