"""Text formats of annotations, dictionaries and notes, read as batch jobs over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions.texts import grade_score
from strophe.sources.records import source_order


def parse_interval_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``start end label`` lines with the reason a line is unusable (null when fine).

    Strict readers treat a reason as an error; lenient readers skip those rows. Blank lines
    carry no reason but no segment either.
    """
    parts = F.split(F.trim(F.col(line)), r"\s+")
    start, end = F.expr("try_cast(_p[0] AS bigint)"), F.expr("try_cast(_p[1] AS bigint)")
    out = lines.withColumn("_p", parts).where(F.trim(F.col(line)) != "")
    out = out.withColumns({"start": start, "end": end, "label": F.get("_p", F.lit(2))})
    reason = (F.when(F.size("_p") < 3, "too_few_fields").when(F.col("start").isNull() | F.col("end").isNull(), "invalid_bounds")
              .when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "non_positive_interval"))
    return out.withColumn("reason", reason).drop("_p")


def parse_lexicon_lines(lines: DataFrame, order: list[str], line: str = "value") -> DataFrame:
    """Dictionary lines to (word, variant, symbols): comments stripped, variant suffix dropped,
    repeated pronunciations kept once, numbered in source order."""
    fields = F.split(F.trim(F.split(F.col(line), "#", 2)[0]), r"\s+")
    rows = lines.withColumn("_f", fields).where((F.size("_f") >= 2) & ~F.col("_f")[0].startswith(";;;"))
    word = F.lower(F.regexp_replace(F.col("_f")[0], r"\(\d+\)$", ""))
    symbols = F.slice("_f", F.lit(2), F.size("_f") - 1)
    first = rows.groupBy(word.alias("word"), symbols.alias("symbols")).agg(F.min(F.struct(*order)).alias("_at"))
    # A word has a handful of pronunciations, so its window is small whatever the file size.
    variant = F.row_number().over(Window.partitionBy("word").orderBy("_at"))
    return first.select("word", variant.alias("variant"), "symbols")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", *source_order())
    return parse_lexicon_lines(lines, ["file", "block", "row"])


def read_section_notes(spark: SparkSession, path: str, section: str, group: str) -> DataFrame:
    """Key -> value of one section of ragged CSV notes, and the mean letter grade per group.

    A section header in the first cell carries forward over the following lines of the same
    file (``last`` ignoring nulls in line order). Notes files are small; each is one window.
    """
    lines = spark.read.text(path).select("value", group, *source_order())
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    rows = lines.withColumn("_c", cells).where(F.exists("_c", lambda c: c != ""))
    head = F.lower(F.get("_c", F.lit(0)))
    named = F.when(head.startswith(section), section).when(head != "", head)
    w = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_section", F.last(named, ignorenulls=True).over(w))
    kept = rows.where((F.col("_section") == section) & (F.size("_c") >= 3) & (F.get("_c", F.lit(1)) != ""))
    at = F.struct("file", "block", "row")
    pairs = kept.groupBy(group, F.lower(F.get("_c", F.lit(1))).alias("key")).agg(F.max_by(F.get("_c", F.lit(2)), at).alias("val"))
    label = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("key", "val"))), lambda p: F.concat_ws("=", p["key"], p["val"])))
    return pairs.groupBy(group).agg(F.avg(grade_score(F.col("val"))).alias("score"), label.alias("label"))

