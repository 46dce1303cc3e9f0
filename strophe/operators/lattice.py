"""Frame-lattice jobs: sequence likelihood, best path, spans and the scores built on them.

One event is one row (its frame matrix is an array of log-probability rows, class 0 is the
blank); Spark spreads events over the cluster. The recursions are folds over frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.vectors import NEG, let, log_add, logsumexp
from strophe.operators.edits import edit_scores


def frame_matrix(frames: DataFrame, event: str, frame: str, vector: str) -> DataFrame:
    """One matrix per event, rows in frame order. A recording's frames are bounded."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(vector).alias("v"))))
    return frames.groupBy(event).agg(F.transform(rows, lambda r: r["v"]).alias("matrix"), F.count(F.lit(1)).alias("n_frames"))


def _states(labels: Column) -> Column:
    """Blank-interleaved state symbols 0, l1, 0, l2, ..., 0."""
    return F.concat(F.flatten(F.transform(labels, lambda s: F.array(F.lit(0), s.cast("int")))), F.array(F.lit(0)))


def _skips(states: Column) -> Column:
    """Whether a state may be entered from two states before."""
    return F.transform(states, lambda s, i: (i >= 2) & (s != 0) & (s != F.coalesce(F.get(states, i - 2), F.lit(-1))))


def _at(a: Column, i: Column) -> Column:
    return F.coalesce(F.when(i >= 0, F.get(a, i)), F.lit(NEG))


def _start(states: Column, first: Column) -> Column:
    return F.transform(states, lambda s, i: F.when(i <= 1, F.get(first, s)).otherwise(F.lit(NEG)))


def _tail(matrix: Column) -> Column:
    return F.slice(matrix, F.lit(2), F.greatest(F.size(matrix) - 1, F.lit(0)))


def forward_log_likelihood(matrix: Column, labels: Column) -> Column:
    """Log-likelihood of a symbol sequence summed over all alignments (null when infeasible)."""

    def run(states: Column) -> Column:
        def with_skips(skip: Column) -> Column:
            def step(acc: Column, row: Column) -> Column:
                def cell(s: Column, i: Column) -> Column:
                    stay = log_add(F.get(acc, i), _at(acc, i - 1))
                    both = F.when(F.get(skip, i), log_add(stay, _at(acc, i - 2))).otherwise(stay)
                    return F.when(both <= NEG / 10, F.lit(NEG)).otherwise(both + F.get(row, s))

                return F.transform(states, cell)

            last = F.aggregate(_tail(matrix), _start(states, F.get(matrix, F.lit(0))), step)
            end = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise(
                log_add(F.get(a, F.size(a) - 1), F.get(a, F.size(a) - 2)))
            return let(let(last, end), lambda v: F.when(v > NEG / 10, v))

        return let(_skips(states), with_skips)

    return let(_states(labels), run)


def viterbi_path(matrix: Column, labels: Column) -> Column:
    """Struct (path: state per frame, score); ties prefer staying, then one step, then a skip."""

    def run(states: Column) -> Column:
        def with_skips(skip: Column) -> Column:
            def step(acc: Column, row: Column) -> Column:
                prev = acc["score"]

                def best(i: Column) -> Column:
                    stay, one = F.get(prev, i), _at(prev, i - 1)
                    two = F.when(F.get(skip, i), _at(prev, i - 2)).otherwise(F.lit(NEG))
                    return (F.when((stay >= one) & (stay >= two), F.struct(stay.alias("v"), F.lit(0).alias("m")))
                            .when(one >= two, F.struct(one.alias("v"), F.lit(1).alias("m")))
                            .otherwise(F.struct(two.alias("v"), F.lit(2).alias("m"))))

                moves = F.transform(states, lambda s, i: F.struct(s.alias("s"), best(i).alias("b")))
                new = F.transform(moves, lambda m: F.when(m["b"]["v"] <= NEG / 10, F.lit(NEG)).otherwise(m["b"]["v"] + F.get(row, m["s"])))
                back = F.transform(moves, lambda m: m["b"]["m"])
                return F.struct(new.alias("score"), F.concat(acc["back"], F.array(back)).alias("back"))

            zero = F.struct(_start(states, F.get(matrix, F.lit(0))).alias("score"), F.array().cast("array<array<int>>").alias("back"))
            done = F.aggregate(_tail(matrix), zero, step)

            def trace(d: Column) -> Column:
                n = F.size(states)
                end = F.when(_at(d["score"], n - 2) > F.get(d["score"], n - 1), n - 2).otherwise(n - 1)
                path = F.aggregate(
                    F.reverse(d["back"]), F.array(end),
                    lambda p, b: F.concat(F.array(F.get(p, F.lit(0)) - F.get(b, F.get(p, F.lit(0)))), p))
                score = F.get(d["score"], end)
                return F.when(score > NEG / 10, F.struct(path.alias("path"), score.alias("score")))

            return let(done, trace)

        return let(_skips(states), with_skips)

    return let(_states(labels), run)


def repeats(labels: Column) -> Column:
    """Number of adjacent equal symbols."""
    pairs = F.zip_with(labels, F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))


def min_frames(labels: Column) -> Column:
    """Fewest frames a sequence needs: its length plus its adjacent repeats."""
    return F.size(labels) + repeats(labels)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of k logarithm ratios."""
    terms = F.transform(F.sequence(F.lit(1), k), lambda i: F.log((n - k + i).cast("double")) - F.log(i.cast("double")))
    return F.when(k == 0, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))


def path_count(frames: Column, labels: Column) -> Column:
    """Log number of alignments of a sequence over ``frames`` frames, null when infeasible."""

    def body(r: Column) -> Column:
        u = F.size(labels)
        return F.when(frames >= u + r, log_binomial((frames + u - r).cast("int"), (2 * u).cast("int")))

    return let(repeats(labels), body)


def greedy_symbols(matrix: Column) -> Column:
    """Best class per frame (first on ties), repeats collapsed, blanks dropped."""

    def best(row: Column) -> Column:
        return F.array_position(row, F.array_max(row)).cast("int") - 1

    def collapse(b: Column) -> Column:
        keep = F.transform(b, lambda s, i: F.struct(s.alias("s"), ((s != 0) & ((i == 0) | (s != F.get(b, i - 1)))).alias("k")))
        return F.transform(F.filter(keep, lambda x: x["k"]), lambda x: x["s"])

    return let(F.transform(matrix, best), collapse)


def counterfactual_scores(matrices: DataFrame, targets: DataFrame, event: str, labels: str, symbols: Sequence[int],
                          partitions: int | None = None) -> DataFrame:
    """(event, position, candidate, log_score) of the reference (position null) and every one-position substitution and deletion (-1).

    All edits of an event share one forward and one backward table (see ``edits``).
    """
    single = targets.withColumn("_accepted", F.transform(labels, lambda s: F.array(s)))
    out = edit_scores(matrices, single, event, "_accepted", symbols, partitions)
    return out.withColumn("candidate", F.when(F.col("position").isNotNull(), F.col("candidate")))


def max_alternative(cands: DataFrame, row: Sequence[str], canonical: str, score: str, allowed: DataFrame | None = None,
                    on: Sequence[str] = ("source", "candidate")) -> DataFrame:
    """Canonical minus the best allowed candidate, null when none is feasible."""
    use = cands if allowed is None else cands.join(F.broadcast(allowed.select(*on)), list(on), "left_semi")
    best = use.groupBy(*row).agg(F.max(score).alias("_best"))
    base = cands.select(*row, canonical).distinct()
    return base.join(best, list(row), "left").select(*row, (F.col(canonical) - F.col("_best")).alias("gop"))


def logsumexp_by(df: DataFrame, by: Sequence[str], value: str, out: str = "lse") -> DataFrame:
    """Grouped log-sum-exp and log-mean-exp with the group maximum shifted out."""
    top = df.groupBy(*by).agg(F.max(value).alias("_mx"))
    j = df.join(top, list(by))
    s = j.groupBy(*by).agg(F.max("_mx").alias("_mx"), F.sum(F.exp(F.col(value) - F.col("_mx"))).alias("_s"), F.count(value).alias("_n"))
    return s.select(*by, (F.col("_mx") + F.log("_s")).alias(out), (F.col("_mx") + F.log(F.col("_s") / F.col("_n"))).alias("lme"), F.col("_n").alias("n"))


def segmentation_free(scores: DataFrame, event: str) -> DataFrame:
    """Canonical minus logsumexp over the {other symbol at i, i deleted} sequences, which are distinct at one position.

    The scores are read once: a position holds at most one inventory of sequences, and the
    canonical value reaches the positions of its event through a window.
    """
    per = scores.groupBy(event, "position").agg(logsumexp(F.collect_list("log_score")).alias("_lse"))
    canonical = F.max(F.when(F.col("position").isNull(), F.col("_lse"))).over(Window.partitionBy(event))
    per = per.withColumn("canonical", canonical).where("position IS NOT NULL")
    return per.select(event, "position", "canonical", (F.col("canonical") - F.col("_lse")).alias("gop"))


def _row_lse(df: DataFrame, row: Sequence[str], value: str, out: str) -> DataFrame:
    """Log-sum-exp over the candidates of a row as a column; a row holds at most one inventory."""
    w = Window.partitionBy(*row)
    df = df.withColumn("_mx", F.max(value).over(w))
    return df.withColumn(out, F.col("_mx") + F.log(F.sum(F.exp(F.col(value) - F.col("_mx"))).over(w))).drop("_mx")


def softmax_temperature(cands: DataFrame, row: Sequence[str], score: str, temperature: float, out: str = "prob") -> DataFrame:
    """Conditional probabilities of candidate scores; impossible (null) scores get zero."""
    scaled = _row_lse(cands.withColumn("_z", F.col(score) / temperature), row, "_z", "_lse")
    return scaled.withColumn(out, F.coalesce(F.exp(F.col("_z") - F.col("_lse")), F.lit(0.0))).drop("_z", "_lse")


def likelihood_ratio(cands: DataFrame, row: Sequence[str], canonical: str, score: str, prior: str, penalty: str | None = None,
                     deletion: int = -1, temperature: float = 1.0) -> DataFrame:
    """Canonical minus logsumexp(candidate + ln prior), with the conditional posterior.

    A deletion penalty is subtracted from the deletion candidate before anything else.
    """
    s = F.col(score)
    if penalty:
        s = F.when(F.col("candidate") == deletion, s - F.col(penalty)).otherwise(s)
    work = _row_lse(cands.withColumn("_w", s + F.log(F.col(prior))), row, "_w", "_mix")
    work = work.withColumn("gop", F.col(canonical) - F.col("_mix"))
    return softmax_temperature(work, row, "_w", temperature, "posterior").drop("_w", "_mix")


def event_posterior(cands: DataFrame, row: Sequence[str], canonical: str, score: str, ops: tuple[float, float, float] = (0.90, 0.07, 0.03),
                    deletion: int = -1) -> DataFrame:
    """P(ok), P(sub), P(del) of a position from its candidate scores and the operation prior."""
    w = Window.partitionBy(*row)
    sub = F.col("candidate") != deletion
    j = cands.withColumn("_mx", F.greatest(F.max(score).over(w), F.max(canonical).over(w)))
    e = F.exp(F.col(score) - F.col("_mx"))
    agg = j.groupBy(*row).agg(
        F.max(ops[0] * F.exp(F.col(canonical) - F.col("_mx"))).alias("ok"),
        (ops[1] * F.avg(F.when(sub, e))).alias("sub"),
        F.sum(F.when(~sub, ops[2] * e)).alias("del"))
    agg = agg.na.fill(0.0, ["sub", "del"]).withColumn("_t", F.col("ok") + F.col("sub") + F.col("del"))
    p = {c: F.col(c) / F.col("_t") for c in ("ok", "sub", "del")}
    return agg.select(*row, *[p[c].alias(f"p_{c}") for c in p], (F.log("ok") - F.log(F.col("sub") + F.col("del"))).alias("log_odds"))


def label_frames(paths: DataFrame, event: str, path: str = "path") -> DataFrame:
    """(event, frame, position) of the frames spent in label states (odd state = label)."""
    flat = paths.select(event, F.posexplode(path).alias("frame", "state"))
    return flat.where("state % 2 = 1").select(event, "frame", ((F.col("state") - 1) / 2).cast("int").alias("position"))


def segment_spans(states: DataFrame, event: str) -> DataFrame:
    """First frame, end frame (exclusive) and frame count per position."""
    return states.groupBy(event, "position").agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.count(F.lit(1)).alias("n_frames"))


def forced_score(states: DataFrame, frame_logp: DataFrame, targets: DataFrame, event: str) -> DataFrame:
    """Log-mean-exp of the target on its frames, the best competitor, margin, and mean log score.

    ``frame_logp`` is long (event, frame, symbol, logp) without the blank.
    """
    j = states.join(frame_logp, [event, "frame"])
    per = logsumexp_by(j, [event, "position", "symbol"], "logp").select(event, "position", "symbol", F.col("lme"))
    mean = j.groupBy(event, "position", "symbol").agg(F.avg("logp").alias("mean_log"))
    per = per.join(mean, [event, "position", "symbol"]).join(
        targets.select(event, F.posexplode("labels").alias("position", "target")), [event, "position"])
    own = F.col("symbol") == F.col("target")
    out = per.groupBy(event, "position").agg(
        F.max(F.when(own, F.col("lme"))).alias("score"), F.max(F.when(own, F.col("mean_log"))).alias("self_score"),
        F.max(F.when(~own, F.struct(F.col("lme").alias("v"), (-F.col("symbol")).alias("s")))).alias("_c"))
    return out.select(event, "position", "score", "self_score", (-F.col("_c.s")).alias("competitor"), F.col("_c.v").alias("competitor_score"),
                      (F.col("score") - F.col("_c.v")).alias("margin"))


def variant_marginal(matrices: DataFrame, positions: DataFrame, event: str, symbols: Sequence[int], partitions: int | None = None) -> DataFrame:
    """Score against the uniform mixture of all accepted pronunciations.

    ``positions`` is one row per event with ``accepted`` (array of arrays). Every perturbation keeps the other positions
    free over their accepted symbols. The mixture is summed inside the recursion, over parallel arcs, so
    work is linear in the positions however many pronunciations there are.
    """
    per = edit_scores(matrices, positions, event, "accepted", symbols, partitions).where("log_score IS NOT NULL")
    normal = F.max(F.when(F.col("position").isNull(), F.col("log_score"))).over(Window.partitionBy(event))
    best = per.withColumn("normal", normal).where("position IS NOT NULL").groupBy(event, "position").agg(
        F.max("normal").alias("normal"),
        F.max(F.struct(F.col("log_score").alias("v"), (F.col("candidate") != -1).alias("_kept"), (-F.col("candidate")).alias("c"))).alias("_b"))
    return best.select(event, "position", (F.col("normal") - F.col("_b.v")).alias("gop"), (-F.col("_b.c")).alias("candidate"))
