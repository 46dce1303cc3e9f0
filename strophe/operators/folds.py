"""Folds, weights and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.scalars import hash_long
from strophe.operators.prefix import ranks


def _numbered(groups: DataFrame, group: str) -> DataFrame:
    """Groups with a 0-based index in sorted order; a group list is small by nature."""
    return groups.select(group).distinct().withColumn("_i", F.row_number().over(Window.orderBy(group)) - 1)


def cyclic_folds(groups: DataFrame, group: str) -> DataFrame:
    """(fold, group, role): group i is tested, group i+1 (cyclic) is development, the rest trains."""
    g = _numbered(groups, group)
    size = g.agg(F.count(F.lit(1)).alias("_n"))
    folds = g.select(F.col(group).alias("fold"), F.col("_i").alias("_f")).crossJoin(size)
    return folds.crossJoin(g).select(
        "fold", group,
        F.when(F.col("_i") == F.col("_f"), "test").when(F.col("_i") == (F.col("_f") + 1) % F.col("_n"), "development")
        .otherwise("training").alias("role"))


def nested_folds(groups: DataFrame, group: str, cohort: str, case: str, labelled: Column | None = None) -> DataFrame:
    """(outer, inner, group, role): leave one case group out, then one of the remaining ones.

    Control groups train in every fold and are never held out; a case group without labels
    may be tested but never trains.
    """
    flag = labelled if labelled is not None else F.lit(True)
    g = groups.select(group, cohort, flag.alias("_lab")).distinct()
    cases = g.where(F.col(cohort) == case)
    outer = cases.select(F.col(group).alias("outer"))
    inner = cases.where("_lab").select(F.col(group).alias("inner"))
    pairs = outer.join(inner, F.col("outer") != F.col("inner"))
    trains = g.where((F.col(cohort) != case) | F.col("_lab"))
    roles = pairs.join(trains, (F.col(group) != F.col("outer")) & (F.col(group) != F.col("inner"))).select(
        "outer", "inner", group, F.when(F.col(cohort) == case, "training").otherwise("control").alias("role"))
    held = pairs.select("outer", "inner", F.col("inner").alias(group), F.lit("validation").alias("role"))
    test = outer.select("outer", F.lit(None).cast("string").alias("inner"), F.col("outer").alias(group), F.lit("test").alias("role"))
    return roles.unionByName(held).unionByName(test)


def group_weights(df: DataFrame, group: str, by: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Add n/(G*n_g): every group has the same total weight and the mean weight is one."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_ng"))
    total = sizes.groupBy(*by).agg(F.sum("_ng").alias("_n"), F.count(F.lit(1)).alias("_g"))
    sizes = sizes.join(total, list(by)) if by else sizes.crossJoin(total)
    sizes = sizes.select(*by, group, (F.col("_n") / (F.col("_g") * F.col("_ng"))).alias(out))
    return df.join(sizes, [*by, group])


def round_robin_sample(df: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows, taken one per group in turn, in hash order inside a group.

    The per-group rank is cut at ``cap`` so Spark limits groups before the shuffle.
    """
    draw = hash_long(F.col(group).cast("string"), F.col(key).cast("string"))
    w = Window.partitionBy(group).orderBy(draw, key)
    turns = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= cap)
    return turns.orderBy("turn", group).limit(cap)


def stratified_median_pick(df: DataFrame, group: str, key: str, length: str, bins: dict[str, tuple[int, int | None]], outside: str = "outside") -> DataFrame:
    """Median item (by length, then key) per group and length bin, plus one more per bin over all groups.

    A bin without an upper end is open. Lengths in no bin, null ones (as 0) included, form the stratum ``outside`` and are reported like the others.
    """
    label = None
    for name, (lo, hi) in bins.items():
        hit = F.col(length) >= lo if hi is None else F.col(length).between(lo, hi)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    rows = df.select(group, key, F.coalesce(F.col(length), F.lit(0)).alias(length)).withColumn("stratum", label.otherwise(outside))
    middle = F.floor(F.col("tot_n") / 2) + 1
    own = ranks(rows, [group, "stratum"], length, key, descending=False).where(F.col("rank") == middle).drop("rank", "tot_n")
    rest = rows.join(own.select(key), key, "left_anti")
    extra = ranks(rest, ["stratum"], length, key, descending=False).where(F.col("rank") == middle).drop("rank", "tot_n")
    return own.withColumn("scope", F.lit("group")).unionByName(extra.withColumn("scope", F.lit("global")))
