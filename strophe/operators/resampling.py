"""Resampling and permutation tests over group-level values.

Draws come from an md5 digest of (replicate, slot), so results do not depend on partitioning
and any SQL engine can repeat them. Replicates are spread over the cluster with ``range``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.scalars import hash_long, ratio
from strophe.functions.stats import correlation_struct

ALPHA = 0.05


def indexed(groups: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Group rows with a 0-based index in name order; one row per group."""
    return groups.select(group, *values).withColumn("_i", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))


def _packed(groups: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """One row with an array of the group values in name order (one entry per group)."""
    rows = F.array_sort(F.collect_list(F.struct(group, *values)))
    return groups.agg(rows.alias("_rows"), F.count(F.lit(1)).alias("n_groups"))


def _replicates(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "rep")


def _interval(df: DataFrame, by: Sequence[str], value: str) -> list[Column]:
    return [F.percentile(value, F.lit(ALPHA / 2)).alias("ci_low"), F.percentile(value, F.lit(1 - ALPHA / 2)).alias("ci_high")]


def paired_bootstrap(groups: DataFrame, group: str, a: str, b: str, replicates: int = 10_000) -> DataFrame:
    """Mean of A minus B over groups with a percentile interval from resampled groups."""
    d = indexed(groups.withColumn("_d", F.col(a) - F.col(b)), group, ["_d"])
    point = d.agg(F.avg("_d").alias("difference"), F.count(F.lit(1)).alias("n_groups"))
    draws = _replicates(groups, replicates).crossJoin(F.broadcast(point.select("n_groups"))).select(
        "rep", "n_groups", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)).alias("slot"))
    draws = draws.select("rep", (hash_long(F.col("rep").cast("string"), F.col("slot").cast("string")) % F.col("n_groups")).alias("_i"))
    means = draws.join(d.select("_i", "_d"), "_i").groupBy("rep").agg(F.avg("_d").alias("m"))
    return point.crossJoin(means.agg(*_interval(means, [], "m"), F.count(F.lit(1)).alias("replicates")))


def ratio_bootstrap(clusters: DataFrame, cluster: str, success: str, total: str, replicates: int = 2_000) -> DataFrame:
    """Ratio of sums with a percentile interval from resampled clusters."""
    d = indexed(clusters, cluster, [success, total])
    point = d.agg(ratio(F.sum(success), F.sum(total)).alias("rate"), F.count(F.lit(1)).alias("n_clusters"))
    draws = _replicates(clusters, replicates).crossJoin(F.broadcast(point.select("n_clusters"))).select(
        "rep", "n_clusters", F.explode(F.sequence(F.lit(0), F.col("n_clusters") - 1)).alias("slot"))
    draws = draws.select("rep", (hash_long(F.col("rep").cast("string"), F.col("slot").cast("string")) % F.col("n_clusters")).alias("_i"))
    rates = draws.join(d, "_i").groupBy("rep").agg(ratio(F.sum(success), F.sum(total)).alias("r"))
    return point.crossJoin(rates.agg(*_interval(rates, [], "r")))


METRICS = ("tau", "abs_tau", "spearman", "pearson")


def stratified_bootstrap(groups: DataFrame, group: str, severity: str, a: str, b: str, replicates: int = 10_000) -> DataFrame:
    """Difference of severity correlations of two scores; groups are resampled within severity.

    Undefined replicates are skipped per metric and counted.
    """
    d = groups.select(group, F.col(severity).cast("double").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = d.withColumns({"_j": F.row_number().over(Window.partitionBy("y").orderBy(group)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("y"))})
    slots = d.select("y", F.col("_j").alias("slot"), "_n")
    draws = _replicates(groups, replicates).crossJoin(slots).select(
        "rep", "y", (hash_long(F.col("rep").cast("string"), F.col("y").cast("int").cast("string"), F.col("slot").cast("string")) % F.col("_n")).alias("_j"))
    rows = draws.join(d.select("y", F.col("_j").cast("long").alias("_j"), "a", "b"), ["y", "_j"])
    packed = rows.groupBy("rep").agg(F.collect_list(F.struct("y", "a", "b")).alias("_r"))
    point = d.agg(F.collect_list(F.struct("y", "a", "b")).alias("_r"))
    reps = _correlation_difference(packed).select("rep", *METRICS)
    obs = _correlation_difference(point)

    def tidy(t: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS]))
        return t.select(*keep, cells.alias("_c")).select(*keep, "_c.*")

    dist = tidy(reps, ["rep"], "v").where("v IS NOT NULL").groupBy("metric").agg(
        *_interval(reps, [], "v"), F.count("v").alias("valid_replicates"))
    return tidy(obs, [], "difference").join(dist, "metric")


def _correlation_difference(packed: DataFrame) -> DataFrame:
    col = lambda f: F.transform("_r", lambda r: r[f])
    j = packed.withColumns({"_y": col("y"), "_a": col("a"), "_b": col("b")})
    j = j.withColumns({"_ca": correlation_struct(F.col("_y"), F.col("_a")), "_cb": correlation_struct(F.col("_y"), F.col("_b"))})
    return j.withColumns({m: F.col(f"_ca.{m}") - F.col(f"_cb.{m}") for m in METRICS})


def _patterns(packed: DataFrame, limit: int = 20) -> DataFrame:
    """All 2^n sign patterns of at most ``limit`` groups; larger inputs fail instead of being cut."""
    guard = F.assert_true(F.col("n_groups") <= limit, F.lit(f"exact enumeration is limited to {limit} groups"))
    checked = packed.withColumn("_ok", guard)
    grid = packed.sparkSession.range(1 << limit).withColumnRenamed("id", "pattern")
    return grid.crossJoin(F.broadcast(checked)).where(
        F.col("_ok").isNull() & (F.col("pattern") < F.pow(F.lit(2), F.col("n_groups"))))


def _sign(pattern: Column, i: Column) -> Column:
    return F.when(F.floor(pattern / F.pow(F.lit(2.0), i)) % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def sign_flip_test(groups: DataFrame, group: str, difference: str) -> DataFrame:
    """Exact two-sided sign-flip test of the mean difference over all 2^n patterns."""
    packed = _packed(groups, group, [difference])
    mean = F.aggregate(
        F.transform("_rows", lambda r, i: r[difference] * _sign(F.col("pattern"), i)), F.lit(0.0), lambda acc, v: acc + v) / F.col("n_groups")
    seen = F.aggregate("_rows", F.lit(0.0), lambda acc, r: acc + r[difference]) / F.col("n_groups")
    rows = _patterns(packed.withColumn("difference", seen)).select("difference", "n_groups", mean.alias("m"))
    hit = F.abs("m") >= F.abs("difference") - 1e-12
    return rows.groupBy("difference", "n_groups").agg(
        F.avg(hit.cast("double")).alias("p_two_sided"), F.count(F.lit(1)).alias("n_permutations"))


#: Groups that an exact test enumerates at most.
EXACT_GROUPS = 20


def _pair_tables(y: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(2, n, n, 2, 2): for groups i, j and what each of them holds (0: swapped, 1: not), the sign product with y, and whether the values differ."""
    gap = values[:, None, :, None] - values[None, :, None, :]
    return np.stack([np.sign(y[:, None] - y[None, :])[:, :, None, None] * np.sign(gap), (gap != 0).astype(float)])


def _within(tables: np.ndarray, members: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(2, patterns): sums over pairs inside one half, for all patterns of its bits."""
    out = np.zeros((2, len(bits)))
    for a, i in enumerate(members):
        for b in range(a):
            out += tables[:, i, members[b]][:, bits[:, a], bits[:, b]]
    return out


def method_swap_test(groups: DataFrame, group: str, severity: str, a: str, b: str) -> DataFrame:
    """(metric, difference, p_two_sided, n_groups, n_permutations): exact within-group swap of two methods; the tau difference is recomputed for every pattern.

    A pattern is a high and a low half. Sums over pairs inside a half are tabulated once per half; a task takes high halves and
    adds the pairs between the halves for all low ones at a time, so 20 groups take 2^10 rows of work, not 2^20 x 190 pairs.
    More than 20 groups are refused; patterns whose tau is undefined (constant values) count in neither side of the share.
    """
    spark = groups.sparkSession
    rows = groups.select(F.col(severity).cast("double"), F.col(a).cast("double"), F.col(b).cast("double")).orderBy(group).limit(EXACT_GROUPS + 1).collect()
    if len(rows) > EXACT_GROUPS:
        raise ValueError(f"an exact test takes at most {EXACT_GROUPS} groups")
    y, first, second = (np.array([float(r[k]) for r in rows]) for k in range(3))
    n = len(rows)
    low, high = np.arange(n // 2), np.arange(n // 2, n)
    bits = lambda k: (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    y_pairs = float((y[:, None] != y[None, :]).sum() / 2)
    # method a holds its own value where the bit is set, method b then holds its own too
    tables = [_pair_tables(y, np.column_stack([second, first])), _pair_tables(y, np.column_stack([first, second]))]
    low_bits, high_bits = bits(len(low)), bits(len(high))
    inside = [(_within(t, low, low_bits), _within(t, high, high_bits)) for t in tables]

    def differences(h: int) -> np.ndarray:
        """(2, low patterns): differences of tau and of |tau| for one high half."""
        taus = []
        for t, (in_low, in_high) in zip(tables, inside):
            cross = t[:, high][:, np.arange(len(high)), :, high_bits[h]].sum(axis=0) if len(high) else np.zeros((2, n, 2))
            cross = cross[:, low]
            total = in_low + in_high[:, h, None] + sum((cross[:, k][:, low_bits[:, k]] for k in range(len(low))), np.zeros((2, len(low_bits))))
            with np.errstate(divide="ignore", invalid="ignore"):
                tau = total[0] / np.sqrt(y_pairs * total[1])
            taus.append(np.where((total[1] > 0) & (y_pairs > 0) & (n >= 3), tau, np.nan))
        return np.stack([taus[0] - taus[1], np.abs(taus[0]) - np.abs(taus[1])])

    observed = differences(len(high_bits) - 1)[:, -1]  # nothing swapped: every bit set

    def run(batches):
        for batch in batches:
            found = [differences(h) for h in batch.column(0).to_pylist()]
            for m in range(2):
                v = np.concatenate([f[m] for f in found]) if found else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([int((np.abs(v) >= abs(observed[m]) - 1e-12).sum())]), pa.array([int(np.isfinite(v).sum())]), pa.array([len(v)])],
                                                 ["m", "hit", "valid", "patterns"])

    parts = spark.range(0, len(high_bits), 1, max(1, min(64, len(high_bits) // 8))).mapInArrow(run, "m int, hit long, valid long, patterns long")
    agg = parts.groupBy("m").agg(F.sum("hit").alias("hit"), F.sum("valid").alias("valid"), F.sum("patterns").alias("n_permutations"))
    names = spark.createDataFrame([(m, name, None if np.isnan(o) else float(o)) for m, (name, o) in enumerate(zip(("tau", "abs_tau"), observed))], "m int, metric string, difference double")
    return names.join(agg, "m").select("metric", "difference", F.try_divide(F.col("hit").cast("double"), F.col("valid")).alias("p_two_sided"), F.lit(n).cast("long").alias("n_groups"), "n_permutations")


def success_rules(macro: DataFrame, improved: DataFrame, adapted: str, comparator: str, min_gain: float = 0.03,
                  required_improved: int = 4, max_drop: float = 0.01) -> DataFrame:
    """Named checks of one method against its comparator, and the verdict.

    ``macro`` is one row per method with ``ap, auroc, brier, top1, del_f1``; ``improved`` is a
    one-row table with ``n_improved``. A missing metric fails its check; when the gain itself
    cannot be computed the verdict is ``not_evaluable``.
    """
    cols = ("ap", "auroc", "brier", "top1", "del_f1")
    a = macro.where(F.col("method") == adapted).select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = macro.where(F.col("method") == comparator).select(*[F.col(c).alias(f"b_{c}") for c in cols])
    best = macro.agg(F.max("ap").alias("best_ap"))
    one = a.crossJoin(b).crossJoin(best).crossJoin(improved)
    diff = {c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in cols}
    checks = {
        "highest_macro_ap": F.col("a_ap") >= F.col("best_ap") - 1e-12,
        "ap_gain": diff["ap"] >= min_gain,
        "groups_improved": F.col("n_improved") >= required_improved,
        "auroc_kept": diff["auroc"] >= -max_drop,
        "brier_kept": diff["brier"] <= max_drop,
        "top1_kept": diff["top1"] >= -max_drop,
        "deletion_f1_kept": diff["del_f1"] >= -max_drop,
    }
    passed = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    every = F.lit(True)
    for v in passed.values():
        every = every & v
    verdict = F.when(diff["ap"].isNull(), "not_evaluable").when(every, "success").otherwise("not_met")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in passed.items()]))
    return one.select(cells.alias("_c"), verdict.alias("verdict"), diff["ap"].alias("ap_difference")).select("_c.*", "verdict", "ap_difference")


def final_assessment(primary: DataFrame, sensitivity: DataFrame, required_improved: int = 5, level: float = 0.05) -> DataFrame:
    """What may be claimed from both cohorts; the second can never rescue the first.

    ``primary`` has one row with ``verdict``; ``sensitivity`` one row with ``difference,
    n_improved, ci_low, p_two_sided``. Every condition must hold for a claim of superiority.
    """
    one = primary.select((F.col("verdict") == "success").alias("primary_success")).crossJoin(sensitivity)
    checks = {
        "direction_positive": F.col("difference") > 0,
        "enough_groups_improved": F.col("n_improved") >= required_improved,
        "interval_above_zero": F.col("ci_low") > 0,
        "exact_test_significant": F.col("p_two_sided") < level,
    }
    one = one.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    supported = F.col("primary_success")
    for k in checks:
        supported = supported & F.col(k)
    return one.select("primary_success", *checks, supported.alias("supported")).withColumn(
        "wording", F.when(F.col("supported"), "statistically_supported_superiority").otherwise("point_estimate_or_negative_result"))
