"""Features, event types, densities and fusion. Every fit reads its rows on the cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.inventory import PHONES
from strophe.functions.scalars import clipped, hash_long, log_ratio, sigmoid, signed_log
from strophe.functions.vectors import dot, let, logsumexp
from strophe.operators.audits import exact_quantiles
from strophe.operators.detection import ranking_metrics
from strophe.operators.folds import group_weights
from strophe.operators.manyfit import newton_fit
from strophe.session import stored


# --- features ----------------------------------------------------------------------------------

def score_cues(evidence: DataFrame) -> DataFrame:
    """Four compressed cues: two sequence scores and two posterior log ratios."""
    cues = {"x1": -F.col("gop"), "x2": -F.col("viterbi_gop"),
            "x3": log_ratio(F.col("sub"), F.col("ok")), "x4": log_ratio(F.col("del"), F.col("ok"))}
    return evidence.withColumns({k: signed_log(v) for k, v in cues.items()})


def standardize(df: DataFrame, train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Training-only mean and population deviation applied to other rows (deviation 0 counts as 1)."""
    stats = train.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return j.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in cols}).drop(*[f"_{t}_{c}" for c in cols for t in "ms"])


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column as plain numbers (one row leaves the cluster)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in cols}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


# Coefficients of the rational approximation of the normal quantile (AS 241).
_CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


#: Upper tail over exp(-x^2/2), inside 7 deviations; from the constant up.
_HART = ((220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02),
         (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02))


def _rational(pair, x: Column) -> Column:
    poly = lambda cs: reduce(lambda acc, c: acc * x + c, reversed(cs[:-1]), F.lit(cs[-1]))
    return poly(pair[0]) / poly(pair[1])


def probit(p: Column) -> Column:
    """Standard normal quantile."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _rational(_NEAR, r - 1.6)).otherwise(_rational(_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _rational(_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Hart's rational form, continued fraction in the tails; 1e-14)."""
    x = F.abs(z)
    tail = x + 0.65
    for i in (4, 3, 2, 1):
        tail = x + i / tail
    upper = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, _rational(_HART, x)).otherwise(1 / tail / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def _count_below(q: Column, x: Column, points: int, upto: bool) -> Column:
    """How many of the ``points`` rising values of ``q`` are below ``x`` (or equal, with ``upto``), by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(points.bit_length()))])

    def step(at: Column, by: Column) -> Column:
        v = F.get(q, at + by - 1)
        return F.when((at + by <= points) & ((v <= x) if upto else (v < x)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def rank_normalize(df: DataFrame, train: DataFrame, col: str, out: str, points: int = 256) -> DataFrame:
    """Values mapped through at most ``points`` exact training quantiles to normal scores.

    Ties of the quantile grid get the middle of their rank range; the ends are clipped.
    """
    grid = exact_quantiles(train, [], col, points)
    packed = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("_q"))
    j = df.crossJoin(F.broadcast(packed))
    x, last = F.col(col), float(points - 1)

    def place(q: Column) -> Column:
        found = F.struct(_count_below(q, x, points, False).alias("below"), _count_below(q, x, points, True).alias("upto"))
        return let(found, lambda n: between(q, n["below"], n["upto"]))

    def between(q: Column, below: Column, upto: Column) -> Column:
        lo, hi = F.get(q, below - 1), F.get(q, below)
        return (F.when(upto == 0, 0.0).when(below >= points, 1.0)
                .when(upto > below, (below + upto - 1) / 2.0 / last).otherwise((below - 1 + (x - lo) / (hi - lo)) / last))

    p = F.greatest(F.least(let(F.col("_q"), place), F.lit(1 - 1e-7)), F.lit(1e-7))
    return j.withColumn("_p", p).withColumn(out, probit(F.col("_p"))).drop("_q", "_p")


def phone_design(df: DataFrame, symbol: str, numeric: Sequence[str], interactions: bool, inventory: Sequence[str] = PHONES,
                 out: str = "features") -> DataFrame:
    """Numeric cues, one-hot symbol and optionally every symbol x cue product as one vector."""
    index = StringIndexerModel.from_labels(list(inventory), inputCol=symbol, outputCol="_si", handleInvalid="error")
    hot = OneHotEncoder(inputCols=["_si"], outputCols=["_oh"], dropLast=False)
    num = VectorAssembler(inputCols=list(numeric), outputCol="_num")
    # The encoder needs the category count only, which the indexer carries as metadata.
    j = index.transform(df)
    j = num.transform(hot.fit(j.limit(1)).transform(j))
    parts = ["_num", "_oh"]
    if interactions:
        j = Interaction(inputCols=["_num", "_oh"], outputCol="_ix").transform(j)
        parts.append("_ix")
    return VectorAssembler(inputCols=parts, outputCol=out).transform(j).drop("_si", "_oh", "_num", "_ix")


# --- fits --------------------------------------------------------------------------------------

def apply_calibration(df: DataFrame, score: str, slope: float | Column, intercept: float | Column, threshold: float | Column,
                      gate: float | None = None, margin_floor: float = 0.1) -> DataFrame:
    """p_error, decision, authorisation of a specific statement, and status text."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    out = df.withColumn("p_error", sigmoid(wrap(slope) * F.col(score) + wrap(intercept)))
    out = out.withColumn("predicted", F.col("p_error") >= wrap(threshold))
    named = F.col("cand_event").isin("substitution", "deletion")
    allowed = F.lit(False) if gate is None else (
        F.col("predicted") & named & (F.col("cand_conf") >= gate) & (F.col("cand_margin") >= margin_floor))
    out = out.withColumn("authorized", allowed)
    return out.withColumn("status", F.when(F.col("authorized"), F.col("cand_event")).when(F.col("predicted"), "suspected_error").otherwise("acceptable"))


def event_type_fit(train: DataFrame, numeric: Sequence[str], group: str, c: float = 0.1):
    """Substitution-versus-deletion model on the stable errors, groups equal: (apply function, coefficients as rows).

    Coefficients are (term, value) on unscaled cues, the constant first. No errors: all zero, so every probability is one half.
    """
    errors = train.where(F.col("stable_event") & (F.col("gold_error") == 1)).withColumn("_y", (F.col("gold_event") == "substitution").cast("double"))
    scaler = fit_scaler(errors, numeric) if errors.limit(1).count() else {n: (0.0, 1.0) for n in numeric}
    rows = group_weights(errors.select(group, "_y", *[((F.col(n) - m) / d).alias(n) for n, (m, d) in scaler.items()]), group).withColumn("_one", F.lit(1.0))
    rows = stored(rows, "event-types")  # read by every step
    beta = newton_fit(rows, ["_one", *numeric], "_y", "weight", [0.0] + [1 / c] * len(numeric))
    slopes = {n: float(b) / scaler[n][1] for n, b in zip(numeric, beta[1:])}
    constant = float(beta[0]) - sum(slopes[n] * scaler[n][0] for n in numeric)
    table = train.sparkSession.createDataFrame([("constant", constant), *slopes.items()], "term string, value double")

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumn("p_sub", sigmoid(linear_score(list(slopes.values()), constant, numeric)))

    return apply, table


def mixture_fit(x: np.ndarray, components: int, seed: int = 0, max_iter: int = 100, tol: float = 1e-3, ridge: float = 1e-5):
    """Weights, means and full covariances of a Gaussian mixture by EM; ``ridge`` is added to each covariance in every step,
    so that components of fewer vectors than dimensions stay proper. Starts from nearest of spread-out centres, a few rounds of means."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    k = min(components, n)
    centres = x[[int(rng.integers(n))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        i = int(rng.choice(n, p=near / near.sum())) if near.sum() > 0 else int(rng.integers(n))
        centres = np.vstack((centres, x[i]))
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    for _ in range(20):
        own = ((x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)).argmin(axis=1)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    resp, before = np.eye(k)[own], -np.inf
    for _ in range(max_iter):
        size = resp.sum(axis=0) + 10 * np.finfo(float).eps
        means = resp.T @ x / size[:, None]
        covs = np.stack([((x - m).T * r) @ (x - m) / z + ridge * np.eye(d) for m, r, z in zip(means, resp.T, size, strict=True)])
        log_p = np.empty((n, k))
        for j in range(k):
            root = np.linalg.cholesky(covs[j])
            y = np.linalg.solve(root, (x - means[j]).T)
            log_p[:, j] = math.log(size[j] / n) - 0.5 * (d * math.log(2 * math.pi) + (y ** 2).sum(axis=0)) - np.log(np.diag(root)).sum()
        top = log_p.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
        resp = np.exp(log_p - total[:, None])
        if abs(total.mean() - before) < tol:
            break
        before = total.mean()
    return size / n, means, covs


#: Vectors that one task scores at a time, in expectation.
BLOCK = 20_000


def gmm_density(train: DataFrame, test: DataFrame, symbol: str, vector: str, key: str, symbols: Sequence, components: int = 32,
                cap: int = 512, seed: int = 0) -> DataFrame:
    """(key, symbol, density): log density of each vector under the mixture of its own symbol.

    Per symbol at most ``cap`` training vectors, drawn by hash, are used for the fit (that is the
    sampling rule, not a limit on what is scored), so that a task fits a symbol. A symbol of fewer vectors than
    ``components`` has one component for each. Fitted parts are a table, one row per component with the lower triangle of its inverse root;
    vectors of a symbol are dealt into blocks of about ``BLOCK`` and meet the parts of their symbol there, so a common symbol is many tasks and
    nothing is broadcast. Symbols without a mixture give no rows.
    """
    draw = hash_long(F.col(symbol).cast("string"), F.col(key).cast("string"))
    w = Window.partitionBy(symbol).orderBy(draw, key)
    sample = train.where(F.col(symbol).isin(list(symbols))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select(symbol, "_r", vector)
    kinds = dict(test.dtypes)

    def fit(rows):
        rows = rows.sort_values("_r")
        weights, means, covs = mixture_fit(np.stack(rows[vector].to_numpy()).astype(float), components, seed)
        out = []
        for z, m, c in zip(weights, means, covs, strict=True):
            root = np.linalg.cholesky(c)
            const = math.log(max(z, 1e-300)) - 0.5 * len(m) * math.log(2 * math.pi) - np.log(np.diag(root)).sum()
            out.append((rows[symbol].iloc[0], float(const), m.tolist(), np.linalg.inv(root)[np.tril_indices(len(m))].tolist()))
        return pd.DataFrame(out, columns=[symbol, "c", "mu", "lower"])

    parts = stored(sample.groupBy(symbol).applyInPandas(fit, f"{symbol} {dict(train.dtypes)[symbol]}, c double, mu array<double>, lower array<double>"), "mixtures")
    blocks = stored(test.groupBy(symbol).agg(F.ceil(F.count(F.lit(1)) / float(BLOCK)).cast("int").alias("_blocks")), "mixture-blocks")
    dealt = test.join(blocks, symbol).select(symbol, key, vector, F.pmod(F.xxhash64(key, vector), F.col("_blocks")).cast("int").alias("_block"))
    spread = parts.join(blocks, symbol).select(symbol, "c", "mu", "lower", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))

    def score(rows, mixture):
        if rows.empty or mixture.empty:
            return pd.DataFrame({key: [], symbol: [], "density": []})
        x, logs = np.stack(rows[vector].to_numpy()).astype(float), []
        for const, mu, lower in zip(mixture["c"], mixture["mu"], mixture["lower"]):
            inverse = np.zeros((len(mu), len(mu)))
            inverse[np.tril_indices(len(mu))] = lower
            logs.append(const - 0.5 * (((x - np.asarray(mu)) @ inverse.T) ** 2).sum(axis=1))
        logs = np.stack(logs)
        top = logs.max(axis=0)
        return pd.DataFrame({key: rows[key], symbol: rows[symbol], "density": top + np.log(np.exp(logs - top).sum(axis=0))})

    return dealt.groupBy(symbol, "_block").cogroup(spread.groupBy(symbol, "_block")).applyInPandas(score, f"{key} {kinds[key]}, {symbol} {kinds[symbol]}, density double")


# --- fusion ------------------------------------------------------------------------------------

def ensemble_mix(families: Sequence[Sequence[Column]]) -> Column:
    """Mean probability inside each family, families weighted equally, as a clipped logit."""
    means = [reduce(lambda a, b: a + b, f) / len(f) for f in families]
    p = clipped(reduce(lambda a, b: a + b, means) / len(means), 1e-12)
    return F.log(p / (1 - p))


def residual_grid(df: DataFrame, graph: str, isolated: str, delta: str, group: str, label: str,
                  grid: Sequence[float] = (0.0, 0.25, 0.5, 1.0)) -> DataFrame:
    """Group-macro average precision of ``g + w1*delta + w2*(iso - g)`` for every weight pair."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("w1"), F.lit(float(b)).alias("w2")) for a in grid for b in grid]))
    rows = df.select(group, label, graph, isolated, delta, pairs.alias("_w")).select("*", "_w.*").drop("_w")
    mixed = F.col(graph) + F.col("w1") * F.col(delta) + F.col("w2") * (F.col(isolated) - F.col(graph))
    per = ranking_metrics(rows.withColumn("_mix", mixed), ["w1", "w2", group], "_mix", label)
    return per.groupBy("w1", "w2").agg(F.avg("ap").alias("macro_ap"), F.count("ap").alias("n_groups"))


def pairwise_rank_fit(points: DataFrame, pairs: DataFrame, cols: Sequence[str], group: str, label: str, ridge: float):
    """Group-equal logistic loss plus half the pairwise logistic loss plus ridge, in one fit.

    Point rows and difference rows (label 1) are stacked; the constant belongs to point rows only and has no penalty.
    Newton steps need one aggregate of second moments each. ``pairs`` holds ``positive, negative`` keys and a ``weight``.
    """
    total = points.count()
    names = [f"_f{i}" for i in range(len(cols))]
    pts = group_weights(points, group, out="_w")
    point_rows = pts.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)], F.lit(1.0).alias("_one"), F.col(label).cast("double").alias("_y"), (F.col("_w") / total).alias("_w"))
    side = lambda k, t: points.select(F.col("key").alias(k), *[F.col(c).cast("double").alias(f"{t}{n}") for c, n in zip(cols, names)])
    d = pairs.join(side("positive", "a"), "positive").join(side("negative", "b"), "negative")
    pair_rows = d.select(*[(F.col(f"a{n}") - F.col(f"b{n}")).alias(n) for n in names], F.lit(0.0).alias("_one"), F.lit(1.0).alias("_y"), (0.5 * F.col("weight")).alias("_w"))
    rows = stored(point_rows.unionByName(pair_rows), "rank-rows")
    beta = newton_fit(rows, [*names, "_one"], "_y", "_w", [ridge] * len(cols) + [0.0])
    return [float(v) for v in beta[:-1]], float(beta[-1])


def linear_score(coefficients: Sequence[float], intercept: float, cols: Sequence[str]) -> Column:
    return reduce(lambda acc, t: acc + F.col(t[1]) * t[0], zip(coefficients, cols), F.lit(float(intercept)))
