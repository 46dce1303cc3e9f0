"""Correlations of two short arrays (one entry per group) inside a row.

Group tables hold one row per group, so a replicate or permutation is one small
array; Spark spreads replicates. No pairs are ever emitted as rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.vectors import dot, let, total


def _mean(x: Column) -> Column:
    return total(x) / F.size(x)


def _centred(x: Column) -> Column:
    return let(_mean(x), lambda m: F.transform(x, lambda v: v - m))


def pearson(x: Column, y: Column) -> Column:
    def body(p: Column) -> Column:
        sxx, syy = dot(p["a"], p["a"]), dot(p["b"], p["b"])
        return F.try_divide(dot(p["a"], p["b"]), F.sqrt(sxx * syy))

    return let(F.struct(_centred(x).alias("a"), _centred(y).alias("b")), body)


def average_ranks(x: Column) -> Column:
    """Ranks 1..n with ties averaged."""

    def rank(v: Column) -> Column:
        less = F.aggregate(x, F.lit(0), lambda a, u: a + (u < v).cast("int"))
        same = F.aggregate(x, F.lit(0), lambda a, u: a + (u == v).cast("int"))
        return less + (same + 1) / 2.0

    return F.transform(x, rank)


def kendall_b(x: Column, y: Column) -> Column:
    """Kendall's tau-b; null when either array is constant."""
    pairs = F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))

    def body(ps: Column) -> Column:
        def inner(p: Column, f) -> Column:
            return F.aggregate(ps, F.lit(0.0), lambda a, q: a + f(p, q))

        def whole(f) -> Column:
            return F.aggregate(ps, F.lit(0.0), lambda a, p: a + inner(p, f))

        s = whole(lambda p, q: F.signum(p["x"] - q["x"]) * F.signum(p["y"] - q["y"]))
        tx = whole(lambda p, q: (p["x"] != q["x"]).cast("double"))
        ty = whole(lambda p, q: (p["y"] != q["y"]).cast("double"))
        return F.try_divide(s, F.sqrt(tx * ty))

    return let(pairs, body)


def correlation_struct(x: Column, y: Column) -> Column:
    """Struct (tau, abs_tau, spearman, pearson); null entries for constant input or n < 3."""
    ok = (F.size(x) >= 3) & (F.array_min(x) < F.array_max(x)) & (F.array_min(y) < F.array_max(y))

    def body(t: Column) -> Column:
        return F.struct(
            t.alias("tau"), F.abs(t).alias("abs_tau"),
            F.when(ok, pearson(average_ranks(x), average_ranks(y))).alias("spearman"),
            F.when(ok, pearson(x, y)).alias("pearson"))

    return let(F.when(ok, kendall_b(x, y)), body)
