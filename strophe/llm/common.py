"""Small helpers of the corpus operators: tables, keys, written intermediate results."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.session import shared_dir

#: White space of the text contracts: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Java pattern of a word of the text contracts.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """A-Z only; texts of one byte a character take the fast built-in path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_dir(spark)}/strophe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read often, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of texts handed to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches for Python workers bounded by bytes: ten thousand long texts at once would not fit."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == "67108864b":  # Spark's own default
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Join condition on equal columns, nulls being equal."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; 0 for null."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of the membership filter below; it is sent to all tasks as at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 22


def maybe_in(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """Rows of ``df`` that may have a partner in ``keys`` on ``cols``: a bitmap of a fixed size thins them
    out before a shuffle. No partner is lost; the join that follows decides."""
    bit = F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))
    words = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    marked = df.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64").cast("int"))
    hit = marked.join(F.broadcast(words), "_word").where(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1L") == 1)
    return hit.select(*df.columns)
