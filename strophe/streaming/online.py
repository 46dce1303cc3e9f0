"""Streaming variants: the online scorer and one-time acceptance of event ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strophe.functions.scalars import sigmoid
from strophe.operators.feedback import word_rollup


def score_positions(positions: DataFrame, calibration: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frozen calibration of the position's method applied to its score; works on streams and tables.

    ``calibration`` is a small static table (method, slope, intercept), one row per method.
    """
    j = positions.join(calibration, "method")
    return j.withColumn("p_error", sigmoid(F.col("slope") * F.col("score") + F.col("intercept"))).withColumn(
        "flagged", F.col("p_error") >= threshold).drop("slope", "intercept")


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_words(positions: DataFrame, calibration: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Score arriving recordings and append the status of their words.

    A recording arrives whole inside one file, so word status is complete per micro-batch.
    Each batch overwrites its own folder, so a retried batch does not write twice.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        words = word_rollup(score_positions(batch, calibration, threshold), ["method", "event", "word"])
        words.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (positions.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def accept_once(events: DataFrame, key: str, ts: str, delay: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the first arrival of every id; state is dropped once the watermark has passed it."""
    once = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return (once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
