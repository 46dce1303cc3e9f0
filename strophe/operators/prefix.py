"""Running totals and ranks inside groups of any size.

A plain window ``PARTITION BY group ORDER BY score`` sorts a whole group in one task; when
one group holds a third of all rows that task never ends. Here the 64-bit code of a value is
cut into three digits. Totals per first digit of a group and totals per second digit of a first
digit get a window each, rows are ordered inside (group, first, second digit) and lifted by the
totals before. So a window sees at most 2^22 totals or 2^21 distinct values, however many rows a
group has and however close its values lie. Digits are fixed functions of the value, so retries agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from strophe.functions.scalars import order_code

_HIGH, _LOW = "_high", "_low"
_LOW_BITS = 21


def required(df: DataFrame, score: str) -> Column:
    """``score``; a null or NaN is an error, as a rank or a rate over the other rows would be wrong."""
    c = F.col(score)
    bad = c.isNull()
    if df.schema[score].dataType.simpleString() in ("double", "float"):
        bad = bad | F.isnan(c)
    return F.when(bad, F.raise_error(F.lit(f"null or NaN in {score}")).cast(df.schema[score].dataType)).otherwise(c)


def digits(df: DataFrame, order: str, descending: bool = False) -> dict[str, Column]:
    """First and second digit of a column's order code; texts are cut by their first seven bytes."""
    kind = df.schema[order].dataType
    if isinstance(kind, StringType):
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long") * 128
    else:
        code = order_code(F.col(order), isinstance(kind, IntegralType))
    code = F.coalesce(-code if descending else code, F.lit(0).cast("long"))
    return {_HIGH: F.shiftright(code, 2 * _LOW_BITS), _LOW: F.shiftright(code, _LOW_BITS).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))}


def running_totals(
    cells: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = True,
    with_next: bool = False,
    then: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive) and ``tot_<c>`` for every column in ``sums``.

    ``cells`` must hold one row per (by, order, then): aggregate ties first. ``then`` are
    further ascending order columns. With ``with_next`` the values of the following cell are
    added as ``next_<c>`` (null at the end). A null or NaN in ``order`` is an error.
    """
    by = list(by)
    rank = F.col(order)
    cells = cells.withColumn(order, required(cells, order))
    cells = cells.withColumns(digits(cells, order, descending))
    edge = F.min_by(F.struct(*sums), -rank if descending else rank)
    low = cells.groupBy(*by, _HIGH, _LOW).agg(*[F.sum(c).alias(f"_l_{c}") for c in sums], *([edge.alias("_first")] if with_next else []))
    high = low.groupBy(*by, _HIGH).agg(
        *[F.sum(f"_l_{c}").alias(f"_h_{c}") for c in sums], *([F.min_by("_first", _LOW).alias("_first_h")] if with_next else []))

    def lifted(rows: DataFrame, key: str, part: Sequence[str], source: str, name: str) -> list[Column]:
        before = Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"{source}{c}").over(before), F.lit(0)).alias(f"{name}{c}") for c in sums]

    high = high.select(
        *by, _HIGH, *lifted(high, _HIGH, by, "_h_", "_ph_"), *[F.sum(f"_h_{c}").over(Window.partitionBy(*by)).alias(f"tot_{c}") for c in sums],
        *([F.lead("_first_h").over(Window.partitionBy(*by).orderBy(_HIGH)).alias("_after_h")] if with_next else []))
    low = low.select(
        *by, _HIGH, _LOW, *lifted(low, _LOW, [*by, _HIGH], "_l_", "_pl_"),
        *([F.lead("_first").over(Window.partitionBy(*by, _HIGH).orderBy(_LOW)).alias("_after_l")] if with_next else []))
    heads = low.join(high, [*by, _HIGH])
    inside = Window.partitionBy(*by, _HIGH, _LOW).orderBy(rank.desc() if descending else rank.asc(), *then)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cells.join(heads, [*by, _HIGH, _LOW])
    out = joined.select(
        "*",
        *[(F.col(f"_ph_{c}") + F.col(f"_pl_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums],
        *([F.coalesce(F.lead(F.struct(*sums)).over(inside), F.col("_after_l"), F.col("_after_h")).alias("_next")] if with_next else []),
    )
    if with_next:
        out = out.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in sums])
    return out.drop(_HIGH, _LOW, "_next", "_after_l", "_after_h", *[f"{p}{c}" for p in ("_ph_", "_pl_") for c in sums])


def ranks(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    key: str,
    descending: bool = True,
    out: str = "rank",
) -> DataFrame:
    """Rank 1..n inside ``by`` by score, ties broken by the ascending ``key`` (a number or a text).

    Adds ``rank`` and ``tot_n`` (rows of the group). Rows are counted per score, and inside a score per
    digits of the key, so that a tie of any size is cut like any other order; rows are numbered
    inside their digits only. A null or NaN score is an error; null keys come first.
    """
    by = list(by)
    rows = df.withColumn(score, required(df, score))
    rows = rows.withColumns({f"_k{c}": v for c, v in digits(rows, key).items()})
    tie = [*by, score, "_k_high", "_k_low"]
    low = rows.groupBy(*tie).agg(F.count(F.lit(1)).alias("n"))
    high = low.groupBy(*tie[:-1]).agg(F.sum("n").alias("n"))
    scores = running_totals(high.groupBy(*by, score).agg(F.sum("n").alias("n")), by, score, ["n"], descending)
    scores = scores.select(*by, score, (F.col("cum_n") - F.col("n")).alias("_s"), "tot_n")

    def before(part: Sequence[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    high = high.withColumn("_h", before(tie[:-2], "_k_high")).drop("n")
    low = low.withColumn("_l", before(tie[:-1], "_k_low")).drop("n")
    heads = low.join(high, tie[:-1]).join(scores, [*by, score])
    inside = Window.partitionBy(*tie).orderBy(key)
    joined = rows.join(heads, tie)
    return joined.select(*df.columns, "tot_n", (F.col("_s") + F.col("_h") + F.col("_l") + F.row_number().over(inside)).alias(out))
