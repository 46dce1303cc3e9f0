"""Connected components of an edge table: the smallest reachable label of every vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b): c is the smallest vertex that v reaches.

    Each round passes the least label over the edges and then jumps from label to label, so a
    chain of n vertices takes about log n rounds. Labels are written every round; hubs are
    pre-aggregated; nothing but one count a round reaches the driver. Edges with a null end are ignored.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    for _ in range(rounds):
        over = both.join(labels.select(F.col("v").alias("b"), "c"), "b").select(F.col("a").alias("v"), "c", F.lit(None).cast("long").alias("was"))
        least = over.union(labels.select("v", "c", F.col("c").cast("long").alias("was"))).groupBy("v").agg(F.min("c").alias("c"), F.max("was").alias("was"))
        jump = least.join(labels.select(F.col("v").alias("w"), F.col("c").alias("d")), F.col("c") == F.col("w"), "left")
        new = written(jump.select("v", F.least("c", F.coalesce("d", "c")).alias("c"), "was"), "labels")
        labels = new.select("v", "c")
        if new.where("c <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
