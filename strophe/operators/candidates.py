"""Candidate selection from frame posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if, ratio


def frame_topk(frames: DataFrame, event: str, logp: str, k: int = 2, floor: float = 0.01) -> DataFrame:
    """Union over an event's frames of the top-k non-blank symbols with posterior >= floor.

    The ranking is inside one frame's array (ties by symbol id), so there is no shuffle
    before the distinct (event, symbol) pairs.
    """
    scored = F.transform(F.slice(logp, F.lit(2), F.size(logp) - 1), lambda v, i: F.struct((-F.exp(v)).alias("p"), (i + 1).alias("symbol")))
    best = F.filter(F.slice(F.array_sort(scored), 1, k), lambda s: -s["p"] >= floor)
    return frames.select(event, F.explode(best).alias("_b")).select(event, F.col("_b.symbol").alias("symbol")).distinct()


def symbol_mass(frames: DataFrame, event: str, logp: str) -> DataFrame:
    """Posterior mass of every non-blank symbol summed over the frames of an event."""
    flat = frames.select(event, F.posexplode(logp).alias("symbol", "v")).where("symbol > 0")
    return flat.groupBy(event, "symbol").agg(F.sum(F.exp("v")).alias("mass"))


def mass_cover(mass: DataFrame, event: str, coverage: float = 0.99) -> DataFrame:
    """Smallest prefix of symbols by mass that covers the share; at most an inventory per partition."""
    order = Window.partitionBy(event).orderBy(F.desc("mass"), "symbol")
    before = F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("mass").over(Window.partitionBy(event))
    return mass.withColumns({"_before": before, "_total": total}).where(
        F.col("_before") < coverage * F.col("_total")).select(event, "symbol", "mass")


def retained_mass(mass: DataFrame, selected: DataFrame, event: str) -> DataFrame:
    """Share of the non-blank mass that the selected symbols keep; 1 when there is no mass."""
    flagged = mass.join(selected.select(event, "symbol", F.lit(True).alias("_in")), [event, "symbol"], "left")
    out = flagged.groupBy(event).agg(
        F.sum("mass").alias("_all"), F.sum(F.when(F.col("_in"), F.col("mass")).otherwise(0.0)).alias("_kept"),
        count_if(F.col("_in")).alias("n_selected"))
    return out.select(event, "n_selected", F.coalesce(ratio(F.col("_kept"), F.col("_all")), F.lit(1.0)).alias("retained"))


def candidate_sets(positions: DataFrame, active: DataFrame, neighbors: DataFrame, event: str) -> DataFrame:
    """Per position: (active symbols of the event, or neighbours of an accepted symbol) minus accepted.

    ``neighbors`` is one row per source id with an array ``targets``; both side tables are
    arrays bounded by the inventory.
    """
    acts = active.groupBy(event).agg(F.sort_array(F.collect_set("symbol")).alias("active"))
    table = neighbors.agg(F.map_from_entries(F.collect_list(F.struct("source", "targets"))).alias("_map"))
    j = positions.join(acts, event, "left").crossJoin(F.broadcast(table))
    empty = F.array().cast("array<int>")
    extra = F.flatten(F.transform("accepted", lambda a: F.coalesce(F.try_element_at("_map", a), empty)))
    acts_or = F.coalesce("active", empty)
    union = F.array_union(acts_or, extra)
    return j.withColumns({
        "substitutions": F.array_sort(F.array_except(union, F.col("accepted"))), "insertions": acts_or}).drop("_map", "active")


def content_dedup(jobs: DataFrame, content: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """(distinct jobs by content key, routes back from every original row)."""
    keyed = jobs.withColumn("job_key", F.sha2(F.to_json(F.struct(*content)), 256))
    return keyed.dropDuplicates(["job_key"]), keyed


def ranked_candidates(cands: DataFrame, row: Sequence[str], prob: str = "prob", symbol: str = "candidate") -> DataFrame:
    """Top symbol, its probability, margin to the second (0 for a single one) and entropy per row.

    One aggregate: a row holds at most one inventory of candidates, ordered (-p, symbol).
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(prob)).alias("p"), F.col(symbol).alias("c"))))
    out = cands.groupBy(*row).agg(
        F.slice(ranked, 1, 2).alias("_r"),
        (-F.sum(F.col(prob) * F.log(F.greatest(F.col(prob), F.lit(1e-300))))).alias("entropy"))
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return out.select(*row, first["c"].alias("top"), (-first["p"]).alias("p_top"),
                      F.coalesce(second["p"] - first["p"], F.lit(0.0)).alias("margin"), "entropy")


def agreed_set(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of two sources with membership: both, only_a, only_b (one shuffle)."""
    tagged = a.select(*key, F.lit(1).alias("_t")).unionByName(b.select(*key, F.lit(2).alias("_t")))
    return tagged.groupBy(*key).agg(F.bit_or("_t").alias("_t")).select(
        *key, F.when(F.col("_t") == 3, "both").when(F.col("_t") == 1, "only_a").otherwise("only_b").alias("side"))
