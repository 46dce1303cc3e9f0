"""Line-record sources and sinks: JSON lines, CSV tables, file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source_order() -> list[Column]:
    """Columns that restore the order of lines inside files: file, block, row of the task.

    A task reads a block from front to back, so the running id is increasing inside it.
    """
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")]


def _one_object(text: Column) -> Column:
    """Whether a line that begins with a JSON object ends with it: outside of strings, braces and
    brackets balance at the last character and nowhere before."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^{}\[\]]++(?=.)", "")
    # what is left: brackets, and the last character of the line
    step = lambda acc, c: F.struct(
        (acc["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
        (acc["closed"] + ((acc["depth"] == 1) & c.isin("}", "]")).cast("int") + ((acc["depth"] == 0) & ~c.isin("{")).cast("int") * 2).alias("closed"))
    state = F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")), step)
    return (state["depth"] == 0) & (state["closed"] == 1) & text.endswith("}")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON lines, plain or gzip.

    Every line must be one JSON object of the declared schema; blank lines, other JSON values,
    broken lines, and lines with anything after their object go to the quarantine with a reason.
    Nothing is inferred or dropped.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*struct.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    text = F.trim("value")
    parsed = lines.withColumn("_r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = (F.when(text == "", "blank_line").when(~text.startswith("{"), "not_an_object")
              .when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "invalid_json")
              .when(~_one_object(text), "trailing_text"))
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason IS NULL").select(*[F.col(f"_r.{f.name}").alias(f.name) for f in struct.fields])
    return good, parsed.where("reason IS NOT NULL").select("file", "value", "reason")


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Gzip JSON lines, one object per row, in a stable order: ranges of the key, sorted inside."""
    out = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    out.sortWithinPartitions(*order).write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV of a tidy table; an empty one is an error, told from the written rows, so that the plan runs once."""
    df.write.option("header", True).csv(path)
    if df.sparkSession.read.schema(df.schema).option("header", True).csv(path).isEmpty():
        raise ValueError("a CSV without rows")


def file_index(spark: SparkSession, path: str, suffix: str, stem: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Case-folded stem -> all candidate paths, so that ambiguity stays visible.

    Only path columns are read; file contents are pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    hit = files.where(F.lower("path").endswith(suffix.lower()))
    key = F.lower(F.regexp_extract("path", stem, 1))
    return hit.groupBy(key.alias("stem")).agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("n"))
