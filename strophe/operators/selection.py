"""Threshold, gate, temperature and grid selection; weighted quantiles and back-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if, ratio, ratio_or_zero
from strophe.operators.diagnosis import correct_candidate
from strophe.operators.prefix import running_totals


def replace_methods(old: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Rows of ``new`` replace all rows of the methods they name."""
    named = new.select(method).distinct()
    return old.join(named, method, "left_anti").unionByName(new)


def with_backoff(df: DataFrame, specific: DataFrame, overall: DataFrame, on: Sequence[str], value: str, out: str) -> DataFrame:
    """Specific value where there is one, else the single overall value; adds a fallback flag."""
    one = F.broadcast(overall.select(F.col(value).alias("_all")))
    j = df.join(specific.select(*on, F.col(value).alias("_own")), list(on), "left").crossJoin(one)
    return j.withColumns({out: F.coalesce("_own", "_all"), "fallback": F.col("_own").isNull()}).drop("_own", "_all")


def f1_grid(df: DataFrame, by: Sequence[str], p: str, label: str, denominator: int = 100) -> DataFrame:
    """F1 of ``p >= i/denominator`` for i = 1..denominator-1: (by, threshold, f1).

    Rows are first counted per probability cell (at most denominator+1 per group), so the
    grid never multiplies the rows.
    """
    d = float(denominator)
    raw = F.floor(F.col(p) * d)
    cell = F.when((raw + 1) / d <= F.col(p), raw + 1).when(raw / d > F.col(p), raw - 1).otherwise(raw)
    cells = df.groupBy(*by, cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    grid = F.explode(F.sequence(F.lit(1), F.lit(denominator - 1)))
    rows = cells.select("*", grid.alias("_t"))
    hit = F.col("_c") >= F.col("_t")
    out = rows.groupBy(*by, "_t").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("pred"),
        F.sum("_pos").alias("pos"))
    return out.select(*by, (F.col("_t") / d).alias("threshold"), ratio_or_zero(2 * F.col("tp"), F.col("pred") + F.col("pos")).alias("f1"))


def pick_threshold(scores: DataFrame, by: Sequence[str], score: str = "f1") -> DataFrame:
    """Best score; ties go to the threshold nearest 0.5, then the higher one."""
    order = F.struct(F.round(score, 12).alias("s"), (-F.round(F.abs(F.col("threshold") - 0.5), 12)).alias("d"), F.col("threshold").alias("t"))
    return scores.groupBy(*by).agg(F.max_by(F.struct("threshold", score), order).alias("_b")).select(*by, "_b.*")


def threshold_search(df: DataFrame, by: Sequence[str], p: str, label: str) -> DataFrame:
    """Threshold in 0.01..0.99 with the best F1."""
    return pick_threshold(f1_grid(df, by, p, label, 100), by)


def macro_threshold_search(df: DataFrame, by: Sequence[str], group: str, p: str, label: str) -> DataFrame:
    """Threshold in 0.1..0.9 with the best mean F1 over groups."""
    per = f1_grid(df, [*by, group], p, label, 10)
    return pick_threshold(per.groupBy(*by, "threshold").agg(F.avg("f1").alias("f1")), by)


def _gate_table(df: DataFrame, by: Sequence[str], grid: Sequence[float], conf: str, ok: Column, base: Column,
                denominator: Column, covered: Column) -> DataFrame:
    """(by, gate, n, precision, coverage) with one conditional aggregate per grid value."""
    aggs = [count_if(denominator).alias("_den")]
    for i, t in enumerate(grid):
        s = base & (F.col(conf) >= t)
        aggs += [count_if(s).alias(f"_n{i}"), count_if(s & ok).alias(f"_k{i}"), count_if(s & covered).alias(f"_c{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("gate"), F.col(f"_n{i}").alias("n"), ratio(F.col(f"_k{i}"), F.col(f"_n{i}")).alias("precision"),
                 (F.col(f"_c{i}") / F.greatest(F.col("_den"), F.lit(1))).alias("coverage")) for i, t in enumerate(grid)]))
    return wide.select(*by, cells.alias("_g")).select(*by, "_g.*")


def _first_gate(table: DataFrame, by: Sequence[str], good: Column, order: Column) -> DataFrame:
    picked = table.groupBy(*by).agg(F.min_by(F.when(good, F.struct("gate", "n", "precision", "coverage")), F.when(good, order)).alias("_b"))
    return picked.select(*by, "_b.gate", "_b.precision", "_b.coverage", F.col("_b.n").alias("n_selected"))


def gate_search(df: DataFrame, by: Sequence[str], variant: str, threshold: float = 0.5, precision: float = 0.80,
                coverage: float = 0.10, margin: float = 0.10) -> DataFrame:
    """Specific-output gate per fold; null when no gate qualifies, never a weaker one.

    ``largest_coverage``: over stable predicted errors, margin floor, best (coverage, precision, gate).
    ``first_confident``: first confidence in 0.5..0.95 meeting precision and gold-error coverage.
    ``first_joint``: first gate on joint confidence with at least five statements and the precision.
    """
    ok = correct_candidate()
    named = F.col("cand_event").isin("substitution", "deletion")
    stable = F.col("stable_event")
    if variant == "largest_coverage":
        eligible = stable & (F.col("p_error") >= threshold)
        base = eligible & (F.col("cand_margin") >= margin)
        grid = [round(0.50 + 0.05 * i, 2) for i in range(10)]
        t = _gate_table(df, by, grid, "cand_conf", ok, base, eligible, base)
        good = (F.col("n") > 0) & (F.col("precision") >= precision) & (F.col("coverage") >= coverage)
        return _first_gate(t, by, good, F.struct(-F.col("coverage"), -F.col("precision"), -F.col("gate")))
    if variant == "first_confident":
        error = F.col("gold_error") == 1
        base = stable & F.col("predicted") & named & (F.col("cand_margin") >= margin)
        t = _gate_table(df, by, [round(0.50 + 0.05 * i, 2) for i in range(10)], "cand_conf", ok & error, base, stable & error, error)
        good = (F.col("n") > 0) & (F.col("precision") >= precision) & (F.col("coverage") >= coverage)
        return _first_gate(t, by, good, F.struct("gate"))
    if variant == "first_joint":
        base = stable & F.col("predicted") & named
        work = df.withColumn("_joint", F.col("p_error") * F.col("cand_conf"))
        t = _gate_table(work, by, (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), "_joint", ok, base, base, base)
        return _first_gate(t, by, (F.col("n") >= 5) & (F.col("precision") >= precision), F.struct("gate"))
    raise ValueError(f"unknown gate variant {variant!r}")


def type_threshold_search(df: DataFrame, by: Sequence[str], p_sub: str, best_symbol: str,
                          grid: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Substitution-versus-deletion threshold with the best mean of the two F1 scores."""
    exact = F.col("stable_event")
    aggs = [count_if(exact & (F.col("gold_event") == "substitution")).alias("_gs"),
            count_if(exact & (F.col("gold_event") == "deletion")).alias("_gd")]
    for i, t in enumerate(grid):
        sub = exact & F.col("predicted") & (F.col(p_sub) >= t)
        dele = exact & F.col("predicted") & (F.col(p_sub) < t)
        aggs += [count_if(sub).alias(f"_ps{i}"), count_if(dele).alias(f"_pd{i}"),
                 count_if(sub & (F.col("gold_event") == "substitution") & (F.col(best_symbol) == F.col("realized"))).alias(f"_ts{i}"),
                 count_if(dele & (F.col("gold_event") == "deletion")).alias(f"_td{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    one = F.lit(1)
    f1 = lambda i: (2 * F.col(f"_ts{i}") / F.greatest(F.col("_gs") + F.col(f"_ps{i}"), one)
                    + 2 * F.col(f"_td{i}") / F.greatest(F.col("_gd") + F.col(f"_pd{i}"), one)) / 2
    cells = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), f1(i).alias("mean_f1")) for i, t in enumerate(grid)]))
    long = wide.select(*by, cells.alias("_c")).select(*by, "_c.*")
    order = F.struct(F.round("mean_f1", 12), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return long.groupBy(*by).agg(F.max_by(F.struct("threshold", "mean_f1"), order).alias("_b")).select(*by, "_b.*")


def grid_select(scores: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str], digits: int = 12) -> DataFrame:
    """Row with the best rounded metric; exact ties in the declared order of the tie columns."""
    order = F.struct(-F.round(metric, digits), *ties)
    rest = [c for c in scores.columns if c not in by]
    return scores.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*by, "_b.*")


def _log_sum(scores: str, temperature: float) -> Column:
    add = lambda acc, v: acc + F.exp((v - F.col("_mx")) / temperature)
    return F.log(F.aggregate(scores, F.lit(0.0), add))


def temperature_select(df: DataFrame, by: Sequence[str], scores: str, gold: str, weight: str,
                       grid: Sequence[float] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> DataFrame:
    """Temperature with the lowest weighted negative log probability of the gold candidate.

    ``scores`` is an array of candidate log scores, ``gold`` the 1-based position. Exact ties
    prefer 1.0, then the nearest to it.
    """
    work = df.withColumn("_mx", F.array_max(scores)).withColumn("_g", F.element_at(scores, F.col(gold)))
    aggs = []
    for i, t in enumerate(grid):
        lse = _log_sum(scores, float(t))
        nll = lse - (F.col("_g") - F.col("_mx")) / t
        aggs.append((F.sum(F.col(weight) * nll) / F.sum(weight)).alias(f"_t{i}"))
    wide = work.groupBy(*by).agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_t{i}").alias("nll")) for i, t in enumerate(grid)]))
    long = wide.select(*by, cells.alias("_c")).select(*by, "_c.*")
    t = F.col("temperature")
    order = F.struct(F.round("nll", 12), (t != 1.0).cast("int"), F.abs(t - 1.0), t)
    return long.groupBy(*by).agg(F.min_by(F.struct("temperature", "nll"), order).alias("_b")).select(*by, "_b.*")


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Lower weighted quantile: the first value whose cumulative weight share reaches ``q``."""
    cells = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    run = running_totals(cells, by, value, ["_w"], descending=False)
    reached = F.when(F.col("cum__w") / F.col("tot__w") >= q - 1e-12, F.col(value))
    return run.groupBy(*by).agg(F.coalesce(F.min(reached), F.max(value)).alias("quantile"))


def supported_penalty(df: DataFrame, symbol: str, group: str, value: str, q: float = 0.9, min_tokens: int = 20,
                      min_groups: int = 2) -> tuple[DataFrame, DataFrame]:
    """Per-symbol weighted quantile (groups equal) where supported, and the overall one."""
    per = df.groupBy(symbol, group).agg(F.count(F.lit(1)).alias("_n"))
    support = per.groupBy(symbol).agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_g")).where(
        (F.col("_t") >= min_tokens) & (F.col("_g") >= min_groups)).select(symbol)
    own = df.join(support, symbol, "left_semi").join(per.withColumn("_w", 1.0 / F.col("_n")), [symbol, group])
    specific = weighted_quantile(own.select(symbol, value, F.col("_w").alias("w")), [symbol], value, "w", q)
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    overall = weighted_quantile(df.join(totals, group).select(value, (1.0 / F.col("_n")).alias("w")), [], value, "w", q)
    return specific, overall
