"""Error-detection metrics per group, computed from score cells.

All take ``by`` (group columns), a 0/1 ``label`` and a score where higher means error.
A metric that needs both classes is null, never NaN, when one class is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import (
    clipped,
    count_if,
    harmonic,
    harmonic_f1,
    log_loss,
    ratio,
    ratio_or_zero,
)
from strophe.operators.prefix import ranks, running_totals


def score_cells(df: DataFrame, by: Sequence[str], score: str, label: str, **extra: Column) -> DataFrame:
    """One row per (group, distinct score): rows, positives and any extra sums."""
    return df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("pos"),
        *[v.alias(k) for k, v in extra.items()],
    ).withColumn("neg", F.col("n") - F.col("pos"))


def ranking_metrics(
    df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", recall: float = 0.8
) -> DataFrame:
    """Step average precision, tie-aware AUROC and the lowest FPR with TPR >= ``recall``.

    Ties share one threshold. ROC points on a straight segment (same step before and
    after) are not curve points, as in the usual ROC construction.
    """
    cells = score_cells(df, by, score, label)
    curve = running_totals(cells, by, score, ["n", "pos", "neg"], with_next=True)
    two = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    first = F.col("cum_n") == F.col("n")
    straight = ~first & (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    tpr = ratio(F.col("cum_pos"), F.col("tot_pos"))
    fpr = ratio(F.col("cum_neg"), F.col("tot_neg"))
    on_curve = F.coalesce(~straight, F.lit(True)) & (tpr >= recall)
    out = curve.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos_all"),
        F.sum("neg").alias("neg_all"),
        F.sum(ratio(F.col("pos"), F.col("tot_pos")) * F.col("cum_pos") / F.col("cum_n")).alias("_ap"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("_wins"),
        F.min(F.when(on_curve, fpr)).alias("_fpr"),
    )
    return out.select(
        *by,
        "n",
        F.col("pos_all").alias("n_error"),
        ratio(F.col("pos_all"), F.col("n")).alias("prevalence"),
        F.when(two, F.col("_ap")).alias("ap"),
        F.when(two, ratio(F.col("_wins"), F.col("pos_all") * F.col("neg_all"))).alias("auroc"),
        F.when(two, F.col("_fpr")).alias("fpr_at_recall"),
    )


def probability_metrics(
    df: DataFrame, by: Sequence[str], p: str = "p_error", label: str = "label", eps: float = 1e-15,
    clip_brier: bool = False,
) -> DataFrame:
    """Brier score and log loss; ``clip_brier`` squares the clipped probability."""
    q = clipped(F.col(p), eps) if clip_brier else F.col(p)
    return df.groupBy(*by).agg(
        F.avg(F.pow(q - F.col(label), F.lit(2.0))).alias("brier"),
        F.avg(log_loss(F.col(label), F.col(p), eps)).alias("nll"),
    )


def _confusion(predicted: Column, label: Column) -> list[Column]:
    truth = label == 1
    return [
        count_if(predicted & truth).alias("tp"),
        count_if(predicted & ~truth).alias("fp"),
        count_if(~predicted & truth).alias("fn"),
        count_if(~predicted & ~truth).alias("tn"),
    ]


def decision_rates(
    df: DataFrame, by: Sequence[str], label: str = "label", predicted: str = "predicted",
    score: str | None = None,
) -> DataFrame:
    """F1 (0 when undefined), FPR, FNR at the frozen decision.

    With ``score`` also precision, recall and F1 at the natural cutoff ``score > 0``.
    """
    aggs = _confusion(F.col(predicted), F.col(label))
    if score:
        cut = F.col(score) > 0
        aggs += [c.alias(f"_nat{i}") for i, c in enumerate(_confusion(cut, F.col(label))[:3])]
    out = df.groupBy(*by).agg(*aggs)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    cols = [
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, fn + tp).alias("fnr"),
    ]
    if score:
        a, b, c = (F.col(f"_nat{i}") for i in range(3))
        cols += [
            ratio_or_zero(a, a + b).alias("natural_precision"),
            ratio_or_zero(a, a + c).alias("natural_recall"),
            ratio_or_zero(2 * a, 2 * a + b + c).alias("natural_f1"),
        ]
    return out.select(*by, *cols)


def token_metrics(
    df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label",
    p: str = "p_error", predicted: str = "predicted", eps: float = 1e-12,
) -> DataFrame:
    """Ranking, probability and decision metrics of a group in one table."""
    rank = ranking_metrics(df, by, score, label)
    points = df.groupBy(*by).agg(
        F.avg(F.pow(clipped(F.col(p), eps) - F.col(label), F.lit(2.0))).alias("brier"),
        F.avg(log_loss(F.col(label), F.col(p), eps)).alias("nll"),
        *_confusion(F.col(predicted), F.col(label)),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    points = points.select(
        *by, "brier", "nll",
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, fn + tp).alias("fnr"),
    )
    return rank.join(points, list(by)) if by else rank.crossJoin(points)


def macro_average(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of the group metrics: over valid groups, how many, and strict (null if any null)."""
    total = F.count(F.lit(1))
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_macro"),
            F.count(m).alias(f"{m}_groups"),
            F.when(F.count(m) == total, F.avg(m)).alias(f"{m}_strict"),
        ]
    return df.groupBy(*by).agg(*aggs)


def risk_coverage(
    df: DataFrame, by: Sequence[str], p: str, label: str, key: str, threshold: float = 0.5
) -> DataFrame:
    """Area under the risk-coverage curve ordered by ``|p - threshold|``, ties by key.

    The mean prefix risk needs only the ranks of the mistakes: a mistake at rank k adds
    ``H(n) - H(k-1)`` to the sum of prefix risks, so no cumulative curve is kept.
    """
    work = df.select(
        *by, F.col(key).alias("_key"),
        F.abs(F.col(p) - threshold).alias("_conf"),
        ((F.col(p) >= threshold).cast("int") != F.col(label)).alias("_wrong"),
    )
    ranked = ranks(work, by, "_conf", "_key")
    gain = harmonic(F.col("tot_n")) - harmonic(F.col("rank") - 1)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.when(F.col("_wrong"), gain).otherwise(0.0)) / F.count(F.lit(1))).alias("aurc"),
    )


def tie_aware_risk(
    df: DataFrame, by: Sequence[str], p: str, predicted: str, label: str,
    coverages: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0),
) -> DataFrame:
    """Expected risk when ties are ordered at random: area (trapezoid) and fixed coverages.

    Inside a tie of m rows with b mistakes the expected mistakes at step j are ``j*b/m``;
    the sum of prefix risks over a tie is closed-form with harmonic numbers, so a tie of
    any size is one row.
    """
    work = df.select(
        *by,
        F.when(F.col(predicted), F.col(p)).otherwise(1 - F.col(p)).alias("_conf"),
        (F.col(predicted).cast("int") != F.col(label)).cast("long").alias("_wrong"),
    )
    cells = work.groupBy(*by, "_conf").agg(F.count(F.lit(1)).alias("n"), F.sum("_wrong").alias("bad"))
    curve = running_totals(cells, by, "_conf", ["n", "bad"])
    before_n = F.col("cum_n") - F.col("n")
    before_bad = F.col("cum_bad") - F.col("bad")
    rate = F.col("bad") / F.col("n")
    prefix = F.col("n") * rate + (before_bad - rate * before_n) * (
        harmonic(F.col("cum_n")) - harmonic(before_n)
    )
    aggs = [
        F.sum("n").alias("n"),
        F.sum(prefix).alias("_area"),
        F.max(F.col("tot_bad") / F.col("tot_n")).alias("_last"),
        count_if(F.col("n") > 1).alias("tie_groups"),
    ]
    for i, c in enumerate(coverages):
        k = F.greatest(F.lit(1), F.floor(F.col("tot_n") * c))
        inside = (before_n < k) & (k <= F.col("cum_n"))
        aggs.append(F.max(F.when(inside, (before_bad + (k - before_n) * rate) / k)).alias(f"_risk{i}"))
    out = curve.groupBy(*by).agg(*aggs)
    return out.select(
        *by, "n", "tie_groups",
        ((F.col("_area") - F.col("_last") / 2) / F.col("n")).alias("aurc"),
        *[F.col(f"_risk{i}").alias(f"risk_{int(round(c * 100)):03d}") for i, c in enumerate(coverages)],
    )


def precision_at_coverage(
    df: DataFrame, by: Sequence[str], confidence: str, correct: str, key: str,
    coverages: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 1.00),
) -> DataFrame:
    """Share of correct rows among the top ``ceil(c*n)`` by confidence, ties by key."""
    work = df.select(*by, F.col(confidence).alias("_conf"), F.col(correct).alias("_ok"), F.col(key).alias("_key"))
    ranked = ranks(work, by, "_conf", "_key")
    aggs = []
    for i, c in enumerate(coverages):
        top = F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.lit(float(c)) * F.col("tot_n")))
        aggs += [count_if(top).alias(f"_n{i}"), F.avg(F.when(top, F.col("_ok").cast("double"))).alias(f"_p{i}")]
    wide = ranked.groupBy(*by).agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("coverage"), F.col(f"_n{i}").alias("n_selected"), F.col(f"_p{i}").alias("precision"))
        for i, c in enumerate(coverages)]))
    return wide.select(*by, cells.alias("_c")).select(*by, "_c.*")


def matched_fpr_diagnosis(
    df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label",
    targets: Sequence[float] = (0.01, 0.05, 0.10),
) -> DataFrame:
    """Exact substitution/deletion precision, recall and F1 at exactly matched FPR.

    Strictly higher scores are selected, the boundary score is selected with the fraction
    that meets the false-alarm budget. Everything needed is a cumulative sum at the
    boundary cell. Needs ``stable_event, gold_event, realized, cand_event, cand_symbol``.
    """
    exact = F.col("stable_event")
    extra, names = {}, []
    kinds = {"substitution": ["substitution"], "deletion": ["deletion"], "combined": ["substitution", "deletion"]}
    same = (F.col("cand_event") == F.col("gold_event")) & (
        (F.col("gold_event") == "deletion") | (F.col("cand_symbol") == F.col("realized"))
    )
    for kind, events in kinds.items():
        extra[f"gold_{kind}"] = count_if(F.col("gold_event").isin(events) & exact)
        extra[f"prop_{kind}"] = count_if(F.col("cand_event").isin(events) & exact)
        extra[f"good_{kind}"] = count_if(same & F.col("gold_event").isin(events) & exact)
        names += [f"gold_{kind}", f"prop_{kind}", f"good_{kind}"]
    cells = score_cells(df, by, score, label, **extra)
    curve = running_totals(cells, by, score, ["n", "neg", *names])
    # Each target has exactly one boundary cell: only boundary cells are unfolded.
    before = F.col("cum_neg") - F.col("neg")

    def boundary(t: Column) -> Column:
        want = t * F.col("tot_neg")
        return (F.col("neg") > 0) & (F.col("cum_neg") >= want) & ((before < want) | ((want == 0) & (before == 0)))

    grid = F.array(*[F.lit(float(t)) for t in targets])
    edge = curve.select("*", F.explode(F.filter(grid, boundary)).alias("target_fpr"))
    budget = F.col("target_fpr") * F.col("tot_neg")
    share = F.when(F.col("target_fpr") == 1.0, 1.0).otherwise(
        (budget - (F.col("cum_neg") - F.col("neg"))) / F.col("neg")
    )
    edge = edge.withColumn("share", share)

    def mass(c: str) -> Column:
        partial = F.col(f"cum_{c}") - F.col(c) + F.col("share") * F.col(c)
        return F.when(F.col("target_fpr") == 1.0, F.col(f"tot_{c}").cast("double")).otherwise(partial)

    out = edge.select(
        *by, "target_fpr", ratio(mass("neg"), F.col("tot_neg")).alias("achieved_fpr"),
        F.explode(F.array(*[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(f"tot_gold_{kind}").alias("gold"),
                mass(f"prop_{kind}").alias("proposals"),
                mass(f"good_{kind}").alias("true_positives"),
            ) for kind in kinds
        ])).alias("_k"),
    ).select(*by, "target_fpr", "achieved_fpr", "_k.*")
    out = out.withColumns({
        "precision": ratio_or_zero(F.col("true_positives"), F.col("proposals")),
        "recall": ratio_or_zero(F.col("true_positives"), F.col("gold")),
    })
    return out.withColumn("f1", F.coalesce(harmonic_f1(F.col("precision"), F.col("recall")), F.lit(0.0)))
