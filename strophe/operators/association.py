"""Group-level association with a severity-like label, and event collapsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators.prefix import required, running_totals
from strophe.session import stored


def hierarchical_mean(df: DataFrame, levels: Sequence[str], score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of means up the hierarchy: ``levels`` from the top group down to the recording.

    Every level weighs its children equally. Each step aggregates the previous, smaller
    table; the first one combines map-side. ``n_<level>`` counts the children of each level.
    """
    keys = [*by, *levels]
    out = df.groupBy(*keys).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n_positions"))
    counts = ["n_positions"]
    for depth in range(len(levels) - 1, 0, -1):
        keys = [*by, *levels[:depth]]
        out = out.groupBy(*keys).agg(
            F.avg("score").alias("score"), *[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias(f"n_{levels[depth]}"))
        counts.append(f"n_{levels[depth]}")
    return out


def inconsistent_metadata(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose descriptive fields are not constant."""
    out = df.groupBy(*key).agg(*[(F.min(f) != F.max(f)).alias(f) for f in fields])
    bad = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return out.select(*key, F.explode(bad).alias("field"))


def event_index(recordings: DataFrame, event: Sequence[str], recording: str, fields: Sequence[str]) -> DataFrame:
    """Recordings collapsed to events: sorted recording ids, count, and whether the fields agree.

    An event has a handful of recordings (one per microphone), so its id list is short.
    """
    same = F.lit(True)
    for f in fields:
        same = same & (F.min(f) == F.max(f))
    return recordings.groupBy(*event).agg(
        F.sort_array(F.collect_set(recording)).alias("recordings"), F.count_distinct(recording).alias("n_recordings"),
        same.alias("consistent"), *[F.min(f).alias(f) for f in fields])


def _ranked(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, place, rank, ties): dense place from 0, average rank and ties of every distinct value."""
    per = cells.groupBy(*by, value).agg(F.sum("n").alias("n"), F.lit(1).cast("long").alias("one"))
    run = running_totals(per, by, value, ["n", "one"], descending=False)
    return run.select(*by, value, (F.col("cum_one") - 1).alias(f"{value}_place"), (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(f"{value}_rank"), F.col("n").alias(f"{value}_ties"))


def _discordant(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, d): pairs of rows ordered one way by ``_x`` and the other way by ``_y_place``.

    Two places differ first at one binary digit. Per digit, cells that agree above it are ordered by x, and every zero digit counts
    the one digits at smaller x before it. Running totals are cut by digits of x themselves, so no group is in one task.
    """
    top = cells.agg(F.max("_y_place")).first()[0] or 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(int(top).bit_length() - 1, 0)))).alias("_level")
    spread = cells.select(*by, "_x", "n", "_y_place", levels).withColumns({
        "_above": F.expr("shiftright(_y_place, _level + 1)"), "_digit": F.expr("shiftright(_y_place, _level) & 1")})
    keys = [*by, "_level", "_above"]
    counted = spread.groupBy(*keys, "_x").agg(F.sum(F.when(F.col("_digit") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("_digit") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    run = running_totals(counted, keys, "_x", ["ones"], descending=False)
    pairs = (F.col("cum_ones") - F.col("ones")).cast("decimal(19,0)") * F.col("zeros").cast("decimal(18,0)")
    return run.groupBy(*by).agg(F.sum(pairs.cast("decimal(38,0)")).alias("d"))


def correlations(groups: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, tau, abs_tau, spearman, pearson) of two columns over rows of any number, in groups of any size.

    Rows are counted per (x, y) first. Kendall's tau-b comes from tie counts and discordant pairs, which are counted digit by digit; Spearman
    from average ranks. Null for fewer than three rows or a constant column; a null or NaN is an error.
    """
    by = list(by)
    cells = groups.select(*by, required(groups, x).cast("double").alias("_x"), required(groups, y).cast("double").alias("_y")).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells, "pair-cells")
    cells = stored(cells.join(_ranked(cells, by, "_x"), [*by, "_x"]).join(_ranked(cells, by, "_y"), [*by, "_y"]), "ranked-cells")
    weight = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    means = cells.groupBy(*by).agg(F.sum("n").alias("_all"), *[weight(c).alias(f"{c}_mean") for c in ("_x", "_y", "_x_rank", "_y_rank")])
    joined = cells.join(means, by) if by else cells.crossJoin(F.broadcast(means))
    off = {c: F.col(c) - F.col(f"{c}_mean") for c in ("_x", "_y", "_x_rank", "_y_rank")}
    pairs = lambda v: F.sum((F.col("n").cast("decimal(18,0)") * (v - 1).cast("decimal(19,0)")).cast("decimal(38,0)"))  # noqa: E731  (ordered pairs of ties)
    sums = joined.groupBy(*by).agg(
        F.sum("n").alias("n"), pairs(F.col("_x_ties")).alias("tx"), pairs(F.col("_y_ties")).alias("ty"), pairs(F.col("n")).alias("txy"),
        F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
        *[F.sum(F.col("n") * off[a] * off[b]).alias(name) for name, a, b in (("xy", "_x", "_y"), ("xx", "_x", "_x"), ("yy", "_y", "_y"), ("rs", "_x_rank", "_y_rank"),
                                                                            ("rr", "_x_rank", "_x_rank"), ("ss", "_y_rank", "_y_rank"))])
    d = _discordant(cells, by)
    both = sums.join(d, by, "left") if by else sums.crossJoin(F.broadcast(d))
    # ordered pairs: all, less ties of x and of y, plus ties of both, less twice the discordant ones of either order
    whole = (F.col("n").cast("decimal(18,0)") * (F.col("n") - 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    net = (whole - F.col("tx") - F.col("ty") + F.col("txy") - 4 * F.coalesce("d", F.lit(0))).cast("double")
    tau = net / F.sqrt((whole - F.col("tx")).cast("double") * (whole - F.col("ty")).cast("double"))
    ok = (F.col("n") >= 3) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    cor = lambda a, b, c: F.when(ok, F.try_divide(F.col(a), F.sqrt(F.col(b) * F.col(c))))
    return both.select(*by, "n", F.when(ok, tau).alias("tau"), F.when(ok, F.abs(tau)).alias("abs_tau"), cor("rs", "rr", "ss").alias("spearman"), cor("xy", "xx", "yy").alias("pearson"))
