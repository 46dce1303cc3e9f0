"""Joins and coverage checks between events, positions, lexica and methods.

Lookup tables carry no broadcast hint: adaptive execution broadcasts a side only after its
real size is known, and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import count_if, hash_long
from strophe.operators.prefix import ranks


def join_gold(pred: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach gold labels; only quality-passed, diagnostic, binary-stable positions stay."""
    gold = labels.where(F.col("quality").isNull() & F.col("diagnostic") & F.col("stable_error"))
    return pred.join(gold.select(*on, "gold_error", "gold_event", "realized", "stable_event"), list(on))


def first_pronunciation(lexicon: DataFrame) -> DataFrame:
    """The first listed entry of each word."""
    return lexicon.groupBy("word").agg(F.min_by("symbols", "variant").alias("symbols"))


def lexicon_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Word tokens with their first pronunciation; out-of-vocabulary words stay, flagged."""
    return words.join(first_pronunciation(lexicon), "word", "left").withColumn("oov", F.col("symbols").isNull())


def map_distinct(df: DataFrame, col: str, mapper: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run an expensive mapping once per distinct value and join the result to all rows."""
    mapped = mapper(df.select(col).distinct()).withColumnRenamed(col, "_value")
    return df.join(mapped, F.col(col).eqNullSafe(F.col("_value")), "left").drop("_value")


def fallback_source(events: DataFrame, primary: DataFrame, secondary: DataFrame, on: Sequence[str], value: str,
                    allowed: Column) -> DataFrame:
    """Primary sidecar, else the secondary one where allowed; exactly one candidate or a reason."""
    on = list(on)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_{tag}n"), F.min(value).alias(f"_{tag}v"))

    out = events.join(side(primary, "p"), on, "left").join(side(secondary, "s"), on, "left")
    use_second = F.col("_pn").isNull() & allowed
    n = F.coalesce(F.when(use_second, F.col("_sn")).otherwise(F.col("_pn")), F.lit(0))
    return out.select(
        *events.columns,
        F.when(n == 1, F.when(use_second, F.col("_sv")).otherwise(F.col("_pv"))).alias(value),
        F.when(n == 1, F.when(use_second, "secondary").otherwise("primary")).alias("origin"),
        F.when(n == 0, "missing").when(n > 1, "ambiguous").alias("reason"),
    )


def availability(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: |A|, |A∩B|, |A∩C|, |A∩(B∪C)|, |A∩D| over distinct keys.

    One shuffle: the four sources are stacked with a bit each and combined per key.
    """
    stacked = None
    for bit, df in enumerate((a, b, c, d)):
        part = df.select(group, key, F.lit(1 << bit).alias("_bit"))
        stacked = part if stacked is None else stacked.unionByName(part)
    seen = stacked.groupBy(group, key).agg(F.bit_or("_bit").alias("m"))
    has = lambda m: F.col("m").bitwiseAND(m) != 0
    return seen.groupBy(group).agg(
        count_if(has(1)).alias("n_a"), count_if(has(1) & has(2)).alias("n_ab"), count_if(has(1) & has(4)).alias("n_ac"),
        count_if(has(1) & has(6)).alias("n_abc"), count_if(has(1) & has(8)).alias("n_ad"))


def adjacent_pairing(segments: DataFrame, event: Sequence[str], releases: dict[str, str], others: Sequence[str]) -> DataFrame:
    """Closures and whether the immediately next segment is the contiguous matching release.

    The next segment is found by an equi join on (event, index + 1): no window over an event.
    """
    label = F.lower("label")
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in releases.items() for x in kv]), F.col("closure"))
    closures = segments.where(label.isin([*releases, *others])).select(
        *event, "idx", label.alias("closure"), "end")
    following = segments.select(*event, (F.col("idx") - 1).alias("idx"), label.alias("following"), F.col("start").alias("_s"))
    out = closures.join(following, [*event, "idx"], "left")
    paired = F.coalesce((F.col("following") == expected) & (F.col("end") == F.col("_s")), F.lit(False))
    return out.select(
        *event, "idx", "closure", "following", paired.alias("paired"),
        F.when(paired, "paired_closure_release").otherwise("unpaired_closure_requires_review").alias("status"))


def contexts(roles: DataFrame, fold: str, group: str) -> DataFrame:
    """Context id of each fold: folds with the same contributors share one id."""
    members = F.sort_array(F.collect_set(group))
    return roles.groupBy(fold).agg(F.md5(F.concat_ws(",", members)).alias("context"), F.count_distinct(group).alias("n_groups"))


def crossfit(counts: DataFrame, roles: DataFrame, fold: str, group: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals per context over its contributor groups; ``counts`` is already one row per (group, keys)."""
    ctx = contexts(roles, fold, group)
    members = roles.join(ctx, fold).select("context", group, "n_groups").distinct()
    return members.join(counts, group).groupBy("context", *keys).agg(
        *[F.sum(s).alias(s) for s in sums], F.first("n_groups").alias("n_groups"))


def coverage_gaps(preds: DataFrame, expected: DataFrame, method: str, key: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Missing and extra keys per method against the expected key set (one shuffle on the key)."""
    key = list(key)
    registered = F.array(*[F.lit(m) for m in methods])
    seen = preds.groupBy(*key).agg(F.collect_set(method).alias("_have"))
    both = seen.join(expected.select(*key).distinct().withColumn("_exp", F.lit(True)), key, "full")
    have = F.coalesce("_have", F.array().cast("array<string>"))
    missing = F.when(F.col("_exp"), F.array_except(registered, have)).otherwise(F.array().cast("array<string>"))
    extra = F.when(F.col("_exp"), F.array_except(have, registered)).otherwise(have)
    rows = F.concat(
        F.transform(missing, lambda m: F.struct(m.alias("method"), F.lit("missing").alias("problem"))),
        F.transform(extra, lambda m: F.struct(m.alias("method"), F.lit("extra").alias("problem"))))
    return both.select(*key, F.explode(rows).alias("_r")).select(*key, "_r.*")


def matched_subset(rows: DataFrame, method: str, key: Sequence[str], reference: str) -> DataFrame:
    """Rows of every method on the reference method's keys, with a completeness flag per method."""
    base = rows.where(F.col(method) == reference).select(*key).distinct()
    kept = rows.join(base, list(key), "left_semi")
    size = base.agg(F.count(F.lit(1)).alias("n_reference"))
    return kept.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")).crossJoin(
        size).withColumn("complete", F.col("n") == F.col("n_reference"))


def claim_diff(claimed: DataFrame, observed: DataFrame, key: Sequence[str], value: str, atol: float = 1e-12,
               rtol: float = 1e-10) -> DataFrame:
    """Stored values that differ from recomputed ones, including rows on one side only."""
    key = list(key)
    a = claimed.select(*key, F.col(value).alias("claimed"), F.lit(True).alias("_a"))
    b = observed.select(*key, F.col(value).alias("observed"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    close = F.abs(F.col("claimed") - F.col("observed")) <= F.greatest(F.lit(atol), rtol * F.abs(F.col("observed")))
    same = F.coalesce(close, F.col("claimed").isNull() & F.col("observed").isNull())
    status = (F.when(F.col("_a").isNull(), "not_claimed").when(F.col("_b").isNull(), "not_observed")
              .when(~same, "differs"))
    return both.withColumn("status", status).where("status IS NOT NULL").drop("_a", "_b")


def paired_difference(metrics: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """Per declared pair (a, b): groups, mean difference of group metrics and groups improved."""
    a = metrics.select(F.col("method").alias("a"), group, F.col(value).alias("_va"))
    b = metrics.select(F.col("method").alias("b"), group, F.col(value).alias("_vb"))
    both = pairs.join(a, "a").join(b, ["b", group]).where("_va IS NOT NULL AND _vb IS NOT NULL")
    diff = F.col("_va") - F.col("_vb")
    return both.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(diff).alias("difference"), count_if(diff > 0).alias("n_improved"))


def pair_sample(df: DataFrame, group: str, key: str, label: str, cap: int = 512) -> DataFrame:
    """At most ``cap`` positive x negative pairs per group, each group of equal total weight.

    Pairs are never enumerated: the pair space of a group is cut into ``cap`` strips whose widths
    differ by one at most and that leave no pair out, and one pair index is drawn per strip from 60
    bits of a hash, so draws are distinct and repeatable and every pair can be drawn.
    """
    pos = ranks(df.where(F.col(label) == 1).withColumn("_o", F.lit(0)), [group], "_o", key, out="_r")
    neg = ranks(df.where(F.col(label) == 0).withColumn("_o", F.lit(0)), [group], "_o", key, out="_r")
    sizes = df.groupBy(group).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    sizes = sizes.where("_p > 0 AND _n > 0").withColumn("_m", F.least(F.lit(cap), F.col("_p") * F.col("_n")))
    total = sizes.agg(F.count(F.lit(1)).alias("_g"))
    draws = sizes.crossJoin(total).select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("draw"))
    pairs, strips = F.col("_p") * F.col("_n"), F.col("_m")
    width, rest = F.expr("_p * _n div _m"), pairs % strips
    drawn = hash_long(F.col(group), F.col("draw").cast("string"), digits=15) % (width + (F.col("draw") < rest).cast("long"))
    index = F.col("draw") * width + F.least(F.col("draw"), rest) + drawn
    draws = draws.withColumn("_i", index).select(
        group, "draw", (F.expr("_i div _n") + 1).alias("_pr"),
        (F.col("_i") % F.col("_n") + 1).alias("_nr"), (1.0 / F.col("_g") / F.col("_m")).alias("weight"))
    return (draws.join(pos.select(group, F.col("_r").alias("_pr"), F.col(key).alias("positive")), [group, "_pr"])
            .join(neg.select(group, F.col("_r").alias("_nr"), F.col(key).alias("negative")), [group, "_nr"])
            .select(group, "draw", "positive", "negative", "weight"))


def role_overlaps(roles: DataFrame, fold: str, group: str, role: str) -> DataFrame:
    """Groups that play more than one role in a fold."""
    return roles.groupBy(fold, group).agg(F.sort_array(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)


def undeclared_groups(rows: DataFrame, roles: DataFrame, fold: str, group: str) -> DataFrame:
    """Groups seen without a role, and declared groups without rows."""
    seen = rows.select(fold, group).distinct().withColumn("_s", F.lit(True))
    declared = roles.select(fold, group).distinct().withColumn("_d", F.lit(True))
    both = seen.join(declared, [fold, group], "full")
    return both.select(fold, group, F.when(F.col("_d").isNull(), "undeclared").when(F.col("_s").isNull(), "no_rows").alias("problem")
                       ).where("problem IS NOT NULL")
