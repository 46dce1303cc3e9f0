"""Score-to-probability maps of many models at once, by Newton steps on score cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.scalars import sigmoid
from strophe.operators.folds import group_weights
from strophe.session import stored

VARIANTS = ("ridge", "weighted", "standardized")
#: Newton steps at most; a step of one model is halved while it makes the loss worse.
STEPS = 40


def calibration_cells(df: DataFrame, by: Sequence[str], score: str, label: str, variant: str, group: str | None = None) -> DataFrame:
    """(by, z, n, pos, penalty, centre, scale): rows counted per standardised score, with group weights unless ``ridge``.

    Standardising is a change of coordinates only: ``penalty`` is the factor of slope^2 / 2 in them, so that the
    objective is the variant's own (see ``platt_many``).
    """
    by = list(by)
    work = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"), *([group] if group else []))
    work = group_weights(work, group, by, out="_w") if variant != "ridge" and group else work.withColumn("_w", F.lit(1.0))
    cells = work.groupBy(*by, "_s").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("pos"), F.count(F.lit(1)).alias("_c"))
    moments = cells.groupBy(*by).agg(
        F.sum("_c").alias("_c"), (F.sum(F.col("_s") * F.col("_c")) / F.sum("_c")).alias("centre"), F.sum(F.col("_s") * F.col("_s") * F.col("_c")).alias("_q"))
    deviation = F.sqrt(F.greatest(F.col("_q") / F.col("_c") - F.col("centre") ** 2, F.lit(0.0)))
    moments = moments.withColumn("scale", F.when(deviation <= 1e-12 * (1 + F.abs("centre")), 1.0).otherwise(deviation))
    penalty = {"ridge": 2e-4 * F.col("_c") / F.col("scale") ** 2, "weighted": 1 / F.col("scale") ** 2, "standardized": F.lit(1.0)}[variant]
    moments = moments.select(*by, "centre", "scale", penalty.alias("penalty"))
    cells = cells.drop("_c")
    joined = cells.join(moments, by) if by else cells.crossJoin(F.broadcast(moments))
    return joined.select(*by, ((F.col("_s") - F.col("centre")) / F.col("scale")).alias("z"), "n", "pos", "penalty", "centre", "scale")


def platt_many(df: DataFrame, by: Sequence[str], score: str, label: str, variants: Sequence[str] = ("ridge",), group: str | None = None) -> DataFrame:
    """(by, variant, slope, intercept): logistic calibration of every (by) at once.

    ``ridge``: mean loss + 1e-4 * slope^2, slope >= 0. ``weighted``: groups equal, loss + slope^2 / 2. ``standardized``: as weighted with the
    penalty on standardised scores. Rows become cells of equal score first; each Newton step is one
    aggregate of five sums per model over the cells, so only (by) x variants rows are handled between steps.
    A model of one label keeps a finite slope but its constant only stops by the step limit. No null scores or labels.
    """
    by, spark = list(by), df.sparkSession
    parts = [calibration_cells(df, by, score, label, v, group).withColumn("variant", F.lit(v)) for v in variants]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = stored(cells, "calibration-cells")
    keys = [*by, "variant"]
    first = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("penalty").alias("penalty"), F.max("centre").alias("centre"), F.max("scale").alias("scale")).collect()
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a double, b double"
    state = {}
    for r in first:
        rate = min(max(r["pos"] / r["n"], 1e-6), 1 - 1e-6)
        state[tuple(r[k] for k in keys)] = _Step(rate, r["penalty"], r["centre"], r["scale"], bounded=r["variant"] == "ridge")
    for _ in range(STEPS):
        open_ = {k: s for k, s in state.items() if not s.done}
        if not open_:
            break
        current = spark.createDataFrame([(*k, s.a, s.b) for k, s in open_.items()], schema)
        for r in _sums(cells.join(F.broadcast(current), keys), keys).collect():  # as many rows as there are models
            open_[tuple(r[k] for k in keys)].update(r)
    out = [(*k, *s.result()) for k, s in state.items()]
    return spark.createDataFrame(out, schema.replace(", a double, b double", ", slope double, intercept double"))


def _sums(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = F.col("a") + F.col("b") * F.col("z")
    p = sigmoid(t)
    soft: Column = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    r, h = F.col("n") * p - F.col("pos"), F.col("n") * p * (1 - p)
    return joined.groupBy(*keys).agg(
        F.sum(r).alias("ga"), F.sum(r * F.col("z")).alias("gb"), F.sum(h).alias("haa"), F.sum(h * F.col("z")).alias("hab"),
        F.sum(h * F.col("z") * F.col("z")).alias("hbb"), F.sum(F.col("n") * soft - F.col("pos") * t).alias("loss"))


class _Step:
    """Newton state of one model in standardised coordinates."""

    def __init__(self, rate: float, penalty: float, centre: float, scale: float, bounded: bool):
        import math

        self.base, self.penalty, self.centre, self.scale, self.bounded = math.log(rate / (1 - rate)), penalty, centre, scale, bounded
        self.a, self.b, self.loss, self.da, self.db, self.done = self.base, 0.0, math.inf, 0.0, 0.0, False

    def update(self, r) -> None:
        loss = r["loss"] + 0.5 * self.penalty * self.b ** 2
        if loss > self.loss + 1e-12 * (1 + abs(self.loss)):
            self.da, self.db = self.da / 2, self.db / 2
            self.a, self.b = self.a + self.da, self.b + self.db
            return
        self.loss = loss
        gb, hbb, haa = r["gb"] + self.penalty * self.b, r["hbb"] + self.penalty, r["haa"] + 1e-12
        det = haa * hbb - r["hab"] ** 2
        self.da, self.db = (hbb * r["ga"] - r["hab"] * gb) / det, (haa * gb - r["hab"] * r["ga"]) / det
        self.done = r["ga"] * self.da + gb * self.db < 1e-14 * (1 + abs(loss))
        self.a, self.b = self.a - self.da, self.b - self.db

    def result(self) -> tuple[float, float]:
        # the problem is convex: a negative optimum means that the best slope allowed is zero
        if self.bounded and self.b < 0:
            return 0.0, self.base
        return self.b / self.scale, self.a - self.b * self.centre / self.scale
