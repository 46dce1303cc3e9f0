"""Frame tables: one matrix per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators.lattice import frame_matrix


def load_matrices(frames: DataFrame, wanted: DataFrame, event: str = "event", frame: str = "frame", vector: str = "logits") -> DataFrame:
    """Matrices of the wanted events; an event without frames stays as a row flagged missing."""
    m = frame_matrix(frames.join(wanted.select(event), event, "left_semi"), event, frame, vector)
    return wanted.select(event).join(m, event, "left").withColumn("missing", F.col("matrix").isNull())


def duplicate_frames(frames: DataFrame, event: str = "event", frame: str = "frame") -> DataFrame:
    """Frames stored more than once: two matrices for one event."""
    return frames.groupBy(event, frame).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
