"""Confusion statistics and priors with every group weighted equally.

Inputs are counts per (group, source, op, alternative) as given by ``confusion_counts``, so
whatever follows works on tables bounded by groups x inventory squared. ``by`` may hold a
context column when several training sets are estimated at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.inventory import (
    DELETE,
    IPA_CONFUSION_ALIASES,
    IPA_CONFUSIONS,
    IPA_SYMBOLS,
    PHONES,
    PROJECTION,
    SHORT_LIST,
    phone_table,
    strings,
)
from strophe.functions.scalars import log_ratio, signed_log

# Operation probabilities and insertion rate of the generic prior.
GENERIC_OPS = {"OK": 0.90, "SUB": 0.07, "DEL": 0.03}
GENERIC_INSERTION = 0.02


def symbols_table(df: DataFrame, inventory: Sequence[str], name: str) -> DataFrame:
    """The inventory as a one-column table (bounded by its literal list)."""
    return df.sparkSession.range(1).select(F.explode(strings(inventory)).alias(name))


def dense_counts(counts: DataFrame, inventory: Sequence[str], include_deletion: bool = True) -> DataFrame:
    """All (source, alternative != source) pairs plus deletion, zero-filled."""
    alternatives = [*inventory, DELETE] if include_deletion else list(inventory)
    domain = symbols_table(counts, inventory, "source").crossJoin(symbols_table(counts, alternatives, "alternative"))
    return (domain.where("source <> alternative").join(counts, ["source", "alternative"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def balanced_rates(conf: DataFrame, groups: DataFrame, group: str = "grp", by: Sequence[str] = ()) -> DataFrame:
    """Mean over all training groups of count(source->target) / stable positions of the group.

    The divisor is every training group, also those without any exposure.
    """
    by = list(by)
    exposure = conf.groupBy(*by, group).agg(F.sum("n").alias("_exposure"))
    total = groups.groupBy(*by).agg(F.count_distinct(group).alias("_groups"))
    subs = conf.where((F.col("op") == "SUB") & (F.col("source") != F.col("alternative"))).join(exposure, [*by, group])
    out = subs.groupBy(*by, "source", "alternative").agg(
        F.sum("n").alias("raw_count"), F.count_distinct(group).alias("n_groups"),
        F.sum(F.col("n") / F.col("_exposure")).alias("_rate"))
    out = out.join(total, by) if by else out.crossJoin(total)
    return out.select(*by, "source", "alternative", "raw_count", "n_groups", (F.col("_rate") / F.col("_groups")).alias("rate"))


def topk_neighbors(rates: DataFrame, k: int = 4, min_count: int = 1, by: Sequence[str] = (),
                   inventory: Sequence[str] = PHONES) -> DataFrame:
    """At most ``k`` targets per source, order (-rate, -count, id); at most an inventory per partition."""
    rank_of = F.array_position(strings(inventory), F.col("alternative"))
    w = Window.partitionBy(*by, "source").orderBy(F.desc(F.round("rate", 15)), F.desc("raw_count"), rank_of)
    return rates.where(F.col("raw_count") >= min_count).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_equal_prior(conf: DataFrame, group: str = "grp", inventory: Sequence[str] = PHONES, alpha: float = 20.0,
                      effective: float = 1000.0, min_tokens: int = 20, min_groups: int = 2,
                      by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Operation table (source, op, p, raw_count, fallback) and substitution table (source, target, p).

    Each group is scaled to ``effective / n_groups`` positions. Sources with little support
    use the global operation and target distributions; both are smoothed by ``alpha``.
    """
    by = list(by)
    size = conf.groupBy(*by, group).agg(F.sum("n").alias("_n"))
    groups = size.groupBy(*by).agg(F.count(F.lit(1)).alias("_g"))
    size = size.join(groups, by) if by else size.crossJoin(groups)
    scaled = conf.join(size.withColumn("_scale", effective / F.col("_n") / F.col("_g")).drop("_n", "_g"), [*by, group])
    mass = F.col("n") * F.col("_scale")
    per_source = scaled.groupBy(*by, "source").agg(
        F.sum("n").alias("raw_count"), F.count_distinct(group).alias("n_groups"),
        *[F.sum(F.when(F.col("op") == o, mass).otherwise(0.0)).alias(o) for o in GENERIC_OPS])
    subs = scaled.where("op = 'SUB'").groupBy(*by, "source", F.col("alternative").alias("target")).agg(F.sum(mass).alias("m"))
    return smoothed_prior(per_source, subs, inventory, alpha, min_tokens, min_groups, by)


def left_over(per_group: DataFrame, contexts: DataFrame, group: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(ctx, keys, values): totals of every context, as those of all groups minus those of the groups it leaves out."""
    total = per_group.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    every = contexts.select("ctx").distinct().crossJoin(total)
    left = contexts.join(per_group, group).select("ctx", *keys, *[(-F.col(v)).alias(v) for v in values])
    return every.unionByName(left).groupBy("ctx", *keys).agg(*[F.sum(v).alias(v) for v in values])


def leave_out_prior(conf: DataFrame, contexts: DataFrame, group: str = "grp", inventory: Sequence[str] = PHONES, alpha: float = 20.0,
                    effective: float = 1000.0, min_tokens: int = 20, min_groups: int = 2) -> tuple[DataFrame, DataFrame]:
    """``group_equal_prior`` of many training sets at once, each given by the groups it leaves out, as total minus own.

    ``contexts`` (ctx, ``group``) lists left-out groups; a null group states a context that leaves nothing out. One aggregate makes masses
    per group, their total is shared by all contexts, and only left-out groups are joined per context,
    so the work is one total plus contexts x groups left out, not contexts x groups. Tables carry ``ctx``.
    """
    ops = list(GENERIC_OPS)
    size = conf.groupBy(group).agg(F.sum("n").alias("_n"))
    unit = conf.join(size, group).withColumn("_u", F.col("n") * effective / F.col("_n"))
    own = unit.groupBy(group, "source").agg(
        F.sum("n").alias("raw_count"), F.lit(1).cast("long").alias("n_groups"), *[F.sum(F.when(F.col("op") == o, F.col("_u")).otherwise(0.0)).alias(o) for o in ops])
    own_subs = unit.where("op = 'SUB'").groupBy(group, "source", F.col("alternative").alias("target")).agg(F.sum("_u").alias("m"))

    count = left_over(size.select(group, F.lit("all").alias("_k"), F.lit(1).alias("_g")), contexts, group, ["_k"], ["_g"]).select("ctx", "_g")
    clear = lambda v: F.when(F.abs(v) < 1e-9, 0.0).otherwise(v) / F.col("_g")  # noqa: E731  (what is left of a difference of equal sums)
    per_source = left_over(own, contexts, group, ["source"], ["raw_count", "n_groups", *ops]).where("n_groups > 0").join(count, "ctx").select(
        "ctx", "source", "raw_count", "n_groups", *[clear(F.col(o)).alias(o) for o in ops])
    subs = left_over(own_subs, contexts, group, ["source", "target"], ["m"]).join(count, "ctx").select("ctx", "source", "target", clear(F.col("m")).alias("m")).where("m > 0")
    return smoothed_prior(per_source, subs, inventory, alpha, min_tokens, min_groups, ["ctx"])


def smoothed_prior(per_source: DataFrame, subs: DataFrame, inventory: Sequence[str], alpha: float, min_tokens: int, min_groups: int,
                   by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Operation and substitution tables from masses: ``per_source`` (source, raw_count, n_groups, a column per operation) and
    ``subs`` (source, target, m)."""
    by, ops = list(by), list(GENERIC_OPS)
    overall = per_source.groupBy(*by).agg(*[(F.sum(o) + alpha * GENERIC_OPS[o]).alias(f"g_{o}") for o in ops])
    contexts = overall.crossJoin(symbols_table(per_source, inventory, "source"))
    table = contexts.join(per_source, [*by, "source"], "left").withColumns({
        "raw_count": F.coalesce("raw_count", F.lit(0)), "n_groups": F.coalesce("n_groups", F.lit(0)),
        **{o: F.coalesce(o, F.lit(0.0)) + alpha * GENERIC_OPS[o] for o in ops}})
    weak = (F.col("raw_count") < min_tokens) | (F.col("n_groups") < min_groups)
    table = table.withColumn("fallback", weak)
    for o in ops:
        table = table.withColumn(f"w_{o}", F.when(F.col("fallback"), F.col(f"g_{o}")).otherwise(F.col(o)))
    total = sum((F.col(f"w_{o}") for o in ops[1:]), F.col(f"w_{ops[0]}"))
    flat = table.select(*by, "source", "raw_count", "n_groups", "fallback", F.explode(F.array(*[
        F.struct(F.lit(o).alias("op"), (F.col(f"w_{o}") / total).alias("p")) for o in ops])).alias("_o"))
    op_table = flat.select(*by, "source", "_o.op", "_o.p", "raw_count", "n_groups", "fallback")

    everywhere = subs.groupBy(*by, "target").agg(F.sum("m").alias("gm"))
    domain = table.select(*by, "source", "fallback").crossJoin(symbols_table(per_source, inventory, "target")).where("source <> target")
    dense = domain.join(subs, [*by, "source", "target"], "left").join(everywhere, [*by, "target"], "left")
    w = F.coalesce(F.when(F.col("fallback"), F.col("gm")).otherwise(F.col("m")), F.lit(0.0)) + alpha / (len(inventory) - 1)
    dense = dense.withColumn("w", w)
    part = Window.partitionBy(*by, "source")
    sub_table = dense.select(*by, "source", "target", (F.col("w") / F.sum("w").over(part)).alias("p"), "fallback")
    return op_table, sub_table


def insertion_rate(gaps: DataFrame, group: str, alpha: float = 20.0, effective: float = 1000.0, cap: int = 2) -> DataFrame:
    """Insertion probability per gap from stable diagnostic gaps, groups scaled equally."""
    n = F.size("inserted")
    per = gaps.where("stable AND diagnostic AND quality IS NULL").groupBy(group).agg(
        F.count(F.lit(1)).alias("gaps"), F.sum(F.least(n, F.lit(cap))).alias("s"), F.sum((n < cap).cast("int")).alias("f"),
        F.sum((n > cap).cast("int")).alias("over"))
    groups = gaps.select(group).distinct().agg(F.count(F.lit(1)).alias("_g"))
    per = per.crossJoin(groups).withColumn("_scale", effective / F.col("gaps") / F.col("_g"))
    out = per.agg(F.sum("gaps").alias("gaps"), F.sum("over").alias("over_cap"),
                  F.sum(F.col("s") * F.col("_scale")).alias("success"), F.sum(F.col("f") * F.col("_scale")).alias("failure"))
    return out.withColumn("insertion_probability", (F.col("success") + alpha * GENERIC_INSERTION)
                          / (F.col("success") + F.col("failure") + alpha))


def insertion_symbols(gaps: DataFrame, group: str, inventory: Sequence[str], alpha: float = 20.0, effective: float = 1000.0,
                      cap: int = 2) -> DataFrame:
    """Distribution of inserted symbols over the whole inventory."""
    use = gaps.where("stable AND diagnostic AND quality IS NULL")
    per = use.groupBy(group).agg(F.count(F.lit(1)).alias("gaps"))
    groups = gaps.select(group).distinct().agg(F.count(F.lit(1)).alias("_g"))
    per = per.crossJoin(groups).withColumn("_scale", effective / F.col("gaps") / F.col("_g"))
    hits = use.select(group, F.explode(F.slice("inserted", 1, cap)).alias("symbol")).groupBy(group, "symbol").agg(F.count(F.lit(1)).alias("n"))
    mass = hits.join(per, group).groupBy("symbol").agg(F.sum(F.col("n") * F.col("_scale")).alias("m"))
    dense = symbols_table(gaps, inventory, "symbol").join(mass, "symbol", "left")
    dense = dense.withColumn("w", F.coalesce("m", F.lit(0.0)) + alpha / len(inventory))
    total = dense.agg(F.sum("w").alias("t"))
    return dense.crossJoin(total).select("symbol", (F.col("w") / F.col("t")).alias("p"))


def _distance() -> Column:
    vowel = (F.abs(F.col("a.height") - F.col("b.height")) + F.abs(F.col("a.backness") - F.col("b.backness"))
             + 0.7 * F.abs(F.col("a.rounding") - F.col("b.rounding")))
    consonant = (1.5 * F.abs(F.col("a.place_rank") - F.col("b.place_rank")) / 7.0
                 + F.when(F.col("a.manner") == F.col("b.manner"), 0.0).otherwise(0.6)
                 + F.when(F.col("a.voiced") == F.col("b.voiced"), 0.0).otherwise(0.4))
    return (F.when(F.col("a.vowel") & F.col("b.vowel"), vowel)
            .when(~F.col("a.vowel") & ~F.col("b.vowel"), consonant).otherwise(2.5))


def _category_weight() -> Column:
    obstruent = lambda c: F.col(c).isin("stop", "fricative", "affricate")
    moved = lambda c: F.col(c).isin("alveolar", "velar")
    both = F.lit(1.0)
    both = both * F.when((F.col("a.manner") != F.col("b.manner")) & obstruent("a.manner") & obstruent("b.manner"), 1.8).otherwise(1.0)
    both = both * F.when(F.col("a.voiced") != F.col("b.voiced"), 1.5).otherwise(1.0)
    both = both * F.when((F.col("a.place") != F.col("b.place")) & moved("a.place") & moved("b.place"), 1.6).otherwise(1.0)
    both = both * F.when((F.col("a.manner") == "nasal") | (F.col("b.manner") == "nasal"), 1.3).otherwise(1.0)
    return (F.when(F.col("a.vowel") & F.col("b.vowel"), F.when(F.col("b.phone") == "AH", 2.0).otherwise(1.3))
            .when(F.col("a.vowel") != F.col("b.vowel"), 0.7).otherwise(both))


def distance_prior(spark, deletion_weight: float = 0.5) -> DataFrame:
    """Fixed prior (source, alternative, p): exp(-feature distance) times a category weight."""
    phones = phone_table(spark)
    pairs = phones.alias("a").crossJoin(F.broadcast(phones).alias("b")).where("a.id <> b.id").select(
        F.col("a.phone").alias("source"), F.col("b.phone").alias("alternative"),
        (F.exp(-_distance()) * _category_weight()).alias("w"))
    deleted = phones.select(F.col("phone").alias("source"), F.lit(DELETE).alias("alternative"),
                            (deletion_weight * F.when(F.col("vowel"), 1.1).otherwise(2.0)).alias("w"))
    part = Window.partitionBy("source")
    return pairs.unionByName(deleted).select("source", "alternative", (F.col("w") / F.sum("w").over(part)).alias("p"))


def enrichment_prior(conf: DataFrame, fixed: DataFrame, group: str, cohort: str, case: str, control: str,
                     pseudocount: float = 20.0, cap: float = 4.0) -> DataFrame:
    """Fixed prior times the clipped case/control ratio of group-equal Dirichlet posteriors.

    The mean posterior over groups is ``(sum c/(t+k) + k*fixed*sum 1/(t+k)) / groups``: only
    observed cells are touched and a group that saw the source without errors still counts.
    """
    per = conf.groupBy(cohort, group, "source").agg(F.sum(F.when(F.col("op") != "OK", F.col("n")).otherwise(0)).alias("_t"))
    denom = F.col("_t") + pseudocount
    base = per.groupBy(cohort, "source").agg(F.count(F.lit(1)).alias("_groups"), F.sum(1.0 / denom).alias("_inv"))
    hits = conf.where("op <> 'OK'").join(per, [cohort, group, "source"]).groupBy(cohort, "source", "alternative").agg(
        F.sum(F.col("n") / denom).alias("_hit"))

    def side(name: str, out: str) -> DataFrame:
        b = base.where(F.col(cohort) == name).drop(cohort)
        h = hits.where(F.col(cohort) == name).drop(cohort)
        j = fixed.join(b, "source", "left").join(h, ["source", "alternative"], "left")
        mean = (F.coalesce("_hit", F.lit(0.0)) + pseudocount * F.col("p") * F.col("_inv")) / F.col("_groups")
        return j.select("source", "alternative", F.coalesce(mean, F.col("p")).alias(out))

    both = fixed.join(side(case, "_a"), ["source", "alternative"]).join(side(control, "_b"), ["source", "alternative"])
    ratio_ = F.greatest(F.least(F.col("_a") / F.col("_b"), F.lit(cap)), F.lit(1.0 / cap))
    both = both.withColumn("w", F.col("p") * ratio_)
    return both.select("source", "alternative", (F.col("w") / F.sum("w").over(Window.partitionBy("source"))).alias("p"))


def mixed_prior(fixed: DataFrame, empirical: DataFrame, grid: Sequence[float] = (0.0, 0.25, 0.5, 1.0), eps: float = 0.05) -> DataFrame:
    """``eps/K + (1-eps)((1-lambda) fixed + lambda empirical)`` for every lambda of the grid."""
    both = fixed.withColumnRenamed("p", "_f").join(empirical.withColumnRenamed("p", "_e"), ["source", "alternative"])
    part = Window.partitionBy("source")
    both = both.withColumn("_k", F.count(F.lit(1)).over(part))
    both = both.select("*", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("lam"))
    w = eps / F.col("_k") + (1 - eps) * ((1 - F.col("lam")) * F.col("_f") + F.col("lam") * F.col("_e"))
    both = both.withColumn("w", w)
    return both.select("lam", "source", "alternative", (F.col("w") / F.sum("w").over(Window.partitionBy("lam", "source"))).alias("p"))


def short_list_table(spark, deletion_weight: float = 0.5) -> DataFrame:
    rows = [(s, a, w) for s, alts in SHORT_LIST.items() for a, w in [*alts.items(), (DELETE, deletion_weight)]]
    return spark.createDataFrame(rows, "source string, alternative string, weight double")


def prune_renormalize(prior: DataFrame, keep: DataFrame) -> DataFrame:
    """Only listed candidates stay; their masses are renormalised, weights of the list are not used."""
    kept = prior.join(F.broadcast(keep.select("source", "alternative")), ["source", "alternative"], "left_semi")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("source")))


def confusion_edges(spark) -> DataFrame:
    """The phonetic confusion table as raw (source, target) edges."""
    rows = [(s, t) for s, ts in IPA_CONFUSIONS.items() for t in ts]
    return spark.createDataFrame(rows, "source string, target string")


def projection_table(spark) -> DataFrame:
    """Phonetic symbol -> phone, with the aliases of the confusion table."""
    rows = {k: PROJECTION.get(v, v) for k, v in {**IPA_SYMBOLS, **IPA_CONFUSION_ALIASES}.items()}
    return spark.createDataFrame(list(rows.items()), "symbol string, phone string")


def directed_graph(edges: DataFrame, projection: DataFrame) -> DataFrame:
    """Projected edges with what happened to each: kept, self, duplicate or unmapped."""
    p = F.broadcast(projection)
    out = (edges.join(p.select(F.col("symbol").alias("source"), F.col("phone").alias("s")), "source", "left")
           .join(p.select(F.col("symbol").alias("target"), F.col("phone").alias("t")), "target", "left"))
    first = F.min(F.struct("source", "target")).over(Window.partitionBy("s", "t"))
    return out.withColumn("_first", first).select(
        "source", "target", "s", "t",
        F.when(F.col("s").isNull() | F.col("t").isNull(), "unmapped").when(F.col("s") == F.col("t"), "self")
        .when(F.col("_first") != F.struct("source", "target"), "duplicate").otherwise("kept").alias("status"))


def identity_reliability(conf: DataFrame, group: str, inventory: Sequence[str] = PHONES) -> DataFrame:
    """r = n/(n+10) * min(1, groups/2) from substitutions of each source."""
    subs = conf.where("op = 'SUB'").groupBy("source").agg(F.sum("n").alias("n"), F.count_distinct(group).alias("n_groups"))
    dense = symbols_table(conf, inventory, "source").join(subs, "source", "left").na.fill(0, ["n", "n_groups"])
    return dense.withColumn("reliability", F.col("n") / (F.col("n") + 10.0) * F.least(F.lit(1.0), F.col("n_groups") / 2.0))


def leave_out_reliability(conf: DataFrame, contexts: DataFrame, group: str = "grp", inventory: Sequence[str] = PHONES) -> DataFrame:
    """``identity_reliability`` of many training sets at once, as total minus own; ``contexts`` as for ``leave_out_prior``."""
    own = conf.where("op = 'SUB'").groupBy(group, "source").agg(F.sum("n").alias("n"), F.lit(1).cast("long").alias("n_groups"))
    subs = left_over(own, contexts, group, ["source"], ["n", "n_groups"])
    dense = contexts.select("ctx").distinct().crossJoin(symbols_table(conf, inventory, "source")).join(subs, ["ctx", "source"], "left").na.fill(0, ["n", "n_groups"])
    return dense.withColumn("reliability", F.col("n") / (F.col("n") + 10.0) * F.least(F.lit(1.0), F.col("n_groups") / 2.0))


def prior_edges(op_table: DataFrame, sub_table: DataFrame, conf: DataFrame) -> DataFrame:
    """Every edge with operation, conditional and joint probability, raw count and fallback flag."""
    raw = conf.groupBy("source", "op", "alternative").agg(F.sum("n").alias("raw_train_count"))
    ops = op_table.select("source", "op", F.col("p").alias("op_p"), "fallback")
    plain = ops.where("op <> 'SUB'").select(
        "*", F.when(F.col("op") == "OK", F.col("source")).otherwise(DELETE).alias("alternative"), F.lit(1.0).alias("cond_p"))
    subs = ops.where("op = 'SUB'").join(
        sub_table.select("source", F.col("target").alias("alternative"), F.col("p").alias("cond_p")), "source")
    edges = plain.unionByName(subs).join(raw, ["source", "op", "alternative"], "left")
    return edges.select("source", "op", "alternative", "op_p", "cond_p", (F.col("op_p") * F.col("cond_p")).alias("joint_p"),
                        F.coalesce("raw_train_count", F.lit(0)).alias("raw_train_count"), "fallback")


def prior_arrays(op_table: DataFrame, sub_table: DataFrame, inventory: Sequence[str] = PHONES, by: Sequence[str] = ()) -> DataFrame:
    """One row per source: op probabilities and the substitution distribution as an array by symbol id."""
    by = list(by)
    pos = F.array_position(strings(inventory), F.col("target"))
    subs = sub_table.groupBy(*by, "source").agg(F.map_from_entries(F.collect_list(F.struct(pos.alias("i"), F.col("p")))).alias("_m"))
    ids = F.sequence(F.lit(1), F.lit(len(inventory))).cast("array<bigint>")
    subs = subs.select(*by, "source", F.transform(ids, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("sub_p"))
    ops = op_table.groupBy(*by, "source").agg(*[
        F.max(F.when(F.col("op") == o, F.col("p"))).alias(f"op_{o.lower()}") for o in GENERIC_OPS])
    return ops.join(subs, [*by, "source"])


def _total(a: str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _over_accepted(values: str) -> Column:
    """Sum of an array (by symbol id) over the accepted ids: one or two look-ups, not a pass."""
    return F.aggregate("accepted", F.lit(0.0), lambda acc, i: acc + F.element_at(values, i.cast("int")))


def _where_open(value) -> Column:
    """``value(mass, index)`` for symbols with mass that are not accepted, else zero."""
    def cell(m: Column, i: Column) -> Column:
        blocked = (m == 0) | F.array_contains("accepted", (i + 1).cast("int"))
        return F.when(blocked, F.lit(0.0)).otherwise(value(m, i))

    return F.transform("sub_parts", cell)


def prior_replacement(evidence: DataFrame, priors: DataFrame, on: Sequence[str] = ("source",)) -> DataFrame:
    """Replace the generic prior inside position posteriors by the learned one.

    ``evidence`` has ``ok, del, sub_parts`` (array by id) and ``accepted`` (ids); adds
    ``cf_ok, cf_del`` and ``cf_sub`` (array). Accepted symbols get no substitution mass and the
    learned distribution is renormalised without them. Identity when learned equals generic.
    """
    n = len(PHONES)
    j = evidence.join(priors, list(on))
    left = 1.0 - _over_accepted("sub_p")
    j = j.withColumn("_k", F.col("op_sub") / left / (GENERIC_OPS["SUB"] / (n - F.size("accepted"))))
    j = j.withColumn("_s", _where_open(lambda m, i: m * F.get("sub_p", i) * F.col("_k")))
    j = j.withColumns({"_o": F.col("ok") * F.col("op_ok") / GENERIC_OPS["OK"], "_d": F.col("del") * F.col("op_del") / GENERIC_OPS["DEL"]})
    j = j.withColumn("_t", F.col("_o") + F.col("_d") + _total("_s"))
    scaled = F.transform("_s", lambda v: F.when(v == 0, v).otherwise(v / F.col("_t")))
    return j.withColumns({"cf_ok": F.col("_o") / F.col("_t"), "cf_del": F.col("_d") / F.col("_t"), "cf_sub": scaled}).drop(
        "_k", "_s", "_o", "_d", "_t")


def with_open_parts(evidence: DataFrame) -> DataFrame:
    """Add ``open_parts``: (i, m) of the symbols with mass that are not accepted, by index from 0. It depends on the row alone, so rows that
    meet many priors take it once, before they do."""
    parts = F.transform("sub_parts", lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    blocked = lambda x: (x["m"] == 0) | F.array_contains("accepted", (x["i"] + 1).cast("int"))
    return evidence.withColumn("open_parts", F.filter(parts, lambda x: F.coalesce(~blocked(x), F.lit(True))))


def _over_open(value) -> Column:
    return F.aggregate("open_parts", F.lit(0.0), lambda acc, x: acc + value(x))


def replaced_mass(evidence: DataFrame, priors: DataFrame, on: Sequence[str] = ("source",)) -> DataFrame:
    """``cf_ok, cf_del`` of ``prior_replacement`` and ``cf_mass``, the sum of its ``cf_sub``; ``evidence`` has ``open_parts``."""
    j = evidence.join(priors, list(on))
    left = 1.0 - _over_accepted("sub_p")
    j = j.withColumn("_k", F.col("op_sub") / left / (GENERIC_OPS["SUB"] / (len(PHONES) - F.size("accepted"))))
    j = j.withColumn("_s", F.transform("open_parts", lambda x: x["m"] * F.get("sub_p", x["i"]) * F.col("_k")))
    j = j.withColumns({"_o": F.col("ok") * F.col("op_ok") / GENERIC_OPS["OK"], "_d": F.col("del") * F.col("op_del") / GENERIC_OPS["DEL"]})
    j = j.withColumn("_t", F.col("_o") + F.col("_d") + _total("_s"))
    mass = F.aggregate("_s", F.lit(0.0), lambda acc, v: acc + v / F.col("_t"))
    return j.withColumns({"cf_ok": F.col("_o") / F.col("_t"), "cf_del": F.col("_d") / F.col("_t"), "cf_mass": mass}).drop("_k", "_s", "_o", "_d", "_t")


def compact_features(evidence: DataFrame, priors: DataFrame, reliability: DataFrame, baselines: Sequence[str],
                     on: Sequence[str] = ("source",)) -> DataFrame:
    """Nine compressed cues: four evidence scores, occurrence shift, identity support, three baselines.

    The identity support compares the mass under the reliability-tempered learned distribution
    with the mass under the uniform one; both need only the open mass and its product with
    the learned distribution.
    """
    n = len(PHONES)
    keys = [c for c in on if c in reliability.columns]
    own = evidence if "open_parts" in evidence.columns else with_open_parts(evidence)
    j = own.join(priors, list(on)).join(reliability.select(*keys, "reliability"), keys)
    j = j.withColumns({"_m": _over_open(lambda x: x["m"]), "_mq": _over_open(lambda x: x["m"] * F.get("sub_p", x["i"])), "_left": 1.0 - _over_accepted("sub_p"), "_u": 1.0 / (n - F.size("accepted"))})
    r = F.col("reliability")
    j = j.withColumns({"_num": r * F.col("_mq") / F.col("_left") + (1 - r) * F.col("_u") * F.col("_m"), "_den": F.col("_m") * F.col("_u")})
    cues = {
        "x_score": -F.col("gop"), "x_best": -F.col("viterbi_gop"),
        "x_sub": log_ratio(F.col("sub"), F.col("ok")), "x_del": log_ratio(F.col("del"), F.col("ok")),
        "x_occurrence": log_ratio(F.col("op_sub") + F.col("op_del"), F.col("op_ok")) - F.log(F.lit(0.1 / 0.9)),
        "x_identity": F.when(F.col("_den") > 0, log_ratio(F.col("_num"), F.col("_den"))).otherwise(0.0),
        **{f"x_{b}": -F.col(b) for b in baselines},
    }
    j = j.withColumns({k: signed_log(v) for k, v in cues.items()})
    return j.drop("open_parts", "_m", "_mq", "_left", "_u", "_num", "_den")
