"""Many penalised logistic models over the same rows, all fitted by the same passes.

A fit is a context (a set of features), the groups it must not see and an inverse penalty. One pass sums, per
fit and symbol, gradient and curvature of a small local design (constant and cues); everything else - scaling, one-hot
symbols, symbol x cue products - is linear algebra on those sums. So a pass reads the rows once for all fits,
tasks return fits x symbols rows, and Newton's method on the driver sees small systems only. Where many rows are equal they are
counted first and passes read the counts.

Rows need: ``ctx`` (-1: shared by every context), ``g`` (group code), ``s`` (symbol code), ``y`` (0 or 1) and the cues, none null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.session import stored

SHARED = -1


@dataclass(frozen=True)
class Fit:
    """One model: rows of ``ctx`` and shared ones, without the groups ``out``."""

    name: str
    ctx: int
    out: frozenset[int]
    c: float = 1.0
    interactions: bool = True

    @property
    def view(self) -> tuple[int, frozenset[int]]:
        """What it sees; fits of one view share scaler and weights."""
        return self.ctx, self.out


@dataclass
class GroupSums:
    """Sums per (context, group): count and first two moments of the cues. Any view is a total minus the groups left out."""

    keys: list[tuple[int, int]]
    sums: np.ndarray
    groups: int
    _cache: dict = field(default_factory=dict)

    def seen(self, view) -> np.ndarray:
        ctx, out = view
        return np.array([c in (SHARED, ctx) and g not in out for c, g in self.keys], dtype=bool)

    def scaler(self, view) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of the cues; deviation 0 counts as 1."""
        if ("s", view) not in self._cache:
            ctx, out = view
            mine = np.array([c in (SHARED, ctx) for c, _ in self.keys], dtype=bool)
            left = np.array([g in out for _, g in self.keys], dtype=bool)
            total = self.sums[mine].sum(axis=0) - self.sums[mine & left].sum(axis=0)
            k = (len(total) - 1) // 2
            mean = total[1:k + 1] / max(total[0], 1)
            var = np.maximum(total[k + 1:] / max(total[0], 1) - mean ** 2, 0)
            dev = np.where(var <= 1e-14 * (1 + mean ** 2), 1.0, np.sqrt(var))
            self._cache["s", view] = mean, dev
        return self._cache["s", view]

    def weights(self, view) -> np.ndarray:
        """Weight per group code: all rows over groups over rows of the group; 0 for groups not seen."""
        if ("w", view) not in self._cache:
            counts = np.zeros(self.groups)
            for (c, g), row, ok in zip(self.keys, self.sums, self.seen(view)):
                if ok:
                    counts[g] += row[0]
            have = counts > 0
            self._cache["w", view] = np.where(have, counts.sum() / max(have.sum(), 1) / np.maximum(counts, 1), 0.0)
        return self._cache["w", view]


def group_sums(rows: DataFrame, cues: Sequence[str], groups: int) -> GroupSums:
    """One aggregate; contexts x groups rows reach the driver."""
    found = rows.groupBy("ctx", "g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c) for c in cues], *[F.sum(F.col(c) * F.col(c)) for c in cues]).orderBy("ctx", "g").collect()
    return GroupSums([(r["ctx"], r["g"]) for r in found], np.array([[float(v) for v in r[2:]] for r in found]).reshape(len(found), 1 + 2 * len(cues)), groups)


@dataclass
class Linear:
    """Constant and slopes per symbol, on unscaled cues."""

    fit: Fit
    table: np.ndarray


def counted(rows: DataFrame, cues: Sequence[str], worth: float = 0.5) -> DataFrame:
    """(ctx, g, s, y, cues, n): equal rows once with their count ``n``; rows as they are, with ``n`` = 1, if more than the share ``worth`` of them is distinct.

    The share is an estimate over all rows and decides the plan only: sums are the same either way.
    """
    cols = ["ctx", "g", "s", "y", *cues]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*cols)).alias("d")).first()
    if size["d"] > worth * size["n"]:
        return rows.select(*cols, F.lit(1.0).alias("n"))
    return stored(rows.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("n")), "fit-counts")


def _design(batches: Sequence[pa.RecordBatch], cues: int) -> tuple[np.ndarray, ...]:
    """Columns of some batches, ordered by context and symbol."""
    t = pa.Table.from_batches(batches)
    ctx, g, s, y, *xs, n = (c.to_numpy() for c in t.columns)
    order = np.lexsort((s, ctx))
    z = np.ones((len(order), cues + 1))
    for i, x in enumerate(xs):
        z[:, i + 1] = x[order]
    return ctx[order], g[order], s[order], y[order].astype(np.float64), n[order], z


def gathered(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least ``least`` rows: sums by context and symbol cost less on long runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield held
            held = []
    if held:
        yield held


#: Fits x symbols x tasks that may reach the driver unsummed in one pass; beyond, sums are shuffled first.
DIRECT = 100_000


def newton_sums(rows: DataFrame, cues: Sequence[str], fits: Sequence[tuple[int, np.ndarray, np.ndarray]], tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """(fit, symbol) -> gradient, curvature and loss of all counted rows, for fits given as (context, weight by group, table by symbol)."""
    k = len(cues) + 1
    up = np.triu_indices(k)
    width = k + len(up[0]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for held in gathered(batches):
            ctx, g, s, y, n, z = _design(held, k - 1)
            change = np.flatnonzero((np.diff(ctx) != 0) | (np.diff(s) != 0)) + 1
            runs = list(zip(np.concatenate([[0], change]).tolist(), np.concatenate([change, [len(s)]]).tolist()))
            for i, (fc, weight, table) in enumerate(fits):
                for a, b in runs:
                    if ctx[a] not in (SHARED, fc):
                        continue
                    here, symbol = z[a:b], int(s[a])
                    w = n[a:b] * weight[g[a:b]]
                    if not w.any():
                        continue
                    eta, label = here @ table[symbol], y[a:b]
                    e = np.exp(-np.abs(eta))
                    p = np.where(eta >= 0, 1.0, e) / (1 + e)
                    curve = here.T @ (here * (w * p * (1 - p))[:, None])
                    loss = w @ (np.maximum(eta, 0) + np.log1p(e) - label * eta)
                    row = np.concatenate([here.T @ (w * (p - label)), curve[up], [loss]])
                    old = total.get((i, symbol))
                    total[i, symbol] = row if old is None else old + row
        if total:
            keys, values = zip(*total.items())
            values = np.array(values)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.int32()), pa.array([x for _, x in keys], pa.int32()), *(pa.array(values[:, j]) for j in range(width))],
                                             ["fit", "symbol", *(f"v{j}" for j in range(width))])

    cols = [f"v{j}" for j in range(width)]
    parts = rows.select("ctx", "g", "s", "y", *cues, "n").mapInArrow(run, "fit int, symbol int, " + ", ".join(f"{c} double" for c in cols))
    if tasks * len(fits) * len(fits[0][2]) > DIRECT:
        parts = parts.groupBy("fit", "symbol").agg(*[F.sum(c).alias(c) for c in cols])
    t = parts.toArrow()
    values = np.column_stack([t.column(c).to_numpy() for c in cols])
    out: dict[tuple[int, int], np.ndarray] = {}
    for i, symbol, row in zip(t.column("fit").to_pylist(), t.column("symbol").to_pylist(), values):
        out[i, symbol] = out[i, symbol] + row if (i, symbol) in out else row
    return out


class _Newton:
    """Damped Newton state of one fit: constant and slopes for all, then for every symbol, on scaled cues."""

    def __init__(self, fit: Fit, sums: GroupSums, symbols: int, cues: int):
        self.fit, self.symbols, self.k = fit, symbols, cues + 1
        mean, dev = sums.scaler(fit.view)
        self.scale = np.eye(self.k)  # local raw design -> scaled design
        self.scale[1:, 0], self.scale[1:, 1:] = -mean / dev, np.diag(1 / dev)
        self.weight = sums.weights(fit.view)
        self.own = np.arange(self.k) if fit.interactions else np.array([0])
        size = self.k + symbols * len(self.own)
        self.theta, self.step, self.loss, self.done = np.zeros(size), np.zeros(size), np.inf, False
        self.penalty = np.ones(size)
        self.penalty[0] = 0.0

    def table(self) -> np.ndarray:
        local = np.tile(self.theta[:self.k], (self.symbols, 1))
        local[:, self.own] += self.theta[self.k:].reshape(self.symbols, -1)
        return local @ self.scale

    def update(self, by_symbol: dict[int, np.ndarray]) -> None:
        k, c, m = self.k, self.fit.c, len(self.own)
        up = np.triu_indices(k)
        grad, hess, loss = np.zeros(len(self.theta)), np.zeros((len(self.theta),) * 2), 0.0
        for s, row in by_symbol.items():
            g = self.scale @ row[:k]
            a = np.zeros((k, k))
            a[up] = row[k:-1]
            a = self.scale @ (a + a.T - np.diag(np.diag(a))) @ self.scale.T
            at = slice(k + s * m, k + s * m + m)
            grad[:k] += g
            grad[at] += g[self.own]
            hess[:k, :k] += a
            hess[:k, at] = a[:, self.own]
            hess[at, :k] = a[self.own]
            hess[at, at] = a[np.ix_(self.own, self.own)]
            loss += row[-1]
        loss = c * loss + 0.5 * float((self.penalty * self.theta ** 2).sum())
        if loss > self.loss + 1e-10 * (1 + abs(self.loss)):
            self.step = self.step / 2
            self.theta = self.theta + self.step  # back by half of what was gone
            return
        self.loss = loss
        grad = c * grad + self.penalty * self.theta
        hess = c * hess + np.diag(self.penalty)
        hess[0, 0] += 1e-12
        self.step = np.linalg.solve(hess, grad)
        self.done = float(grad @ self.step) < 1e-13 * (1 + abs(loss))
        self.theta = self.theta - self.step


def fit_logistic(rows: DataFrame, cues: Sequence[str], fits: Sequence[Fit], sums: GroupSums, symbols: int, max_passes: int = 60) -> list[Linear]:
    """Group-equal weighted logistic fits with penalty 1/c on everything but the constant, all by the same passes.

    A fit that sees no rows stays at zero; one label only drives the constant until the passes end.
    """
    rows = counted(rows, cues)
    states, tasks = [_Newton(f, sums, symbols, len(cues)) for f in fits], rows.rdd.getNumPartitions()
    for _ in range(max_passes):
        open_ = [s for s in states if not s.done]
        if not open_:
            break
        found = newton_sums(rows, cues, [(s.fit.ctx, s.weight, s.table()) for s in open_], tasks)
        per: dict[int, dict[int, np.ndarray]] = {i: {} for i in range(len(open_))}
        for (i, symbol), row in found.items():
            per[i][symbol] = row
        for i, s in enumerate(open_):
            if per[i]:
                s.update(per[i])
            else:
                s.done = True
    return [Linear(s.fit, s.table()) for s in states]


def linear_table(spark: SparkSession, models: Sequence[Linear]) -> DataFrame:
    """(model, s, b0, b1, ...): fits x symbols rows, to be joined to whatever is scored."""
    k = models[0].table.shape[1]
    rows = [(m.fit.name, s, *map(float, m.table[s])) for m in models for s in range(len(m.table))]
    return spark.createDataFrame(rows, "model string, s int, " + ", ".join(f"b{i} double" for i in range(k)))


def linear_score(cues: Sequence[str]) -> Column:
    """Decision value from the columns of ``linear_table``."""
    return sum((F.col(f"b{i + 1}") * F.col(c) for i, c in enumerate(cues)), F.col("b0"))


def newton_fit(rows: DataFrame, columns: Sequence[str], label: str, weight: str, penalty: Sequence[float], steps: int = 60) -> np.ndarray:
    """Coefficients of one logistic model of few columns: sum of weighted losses + sum(penalty * coefficient^2) / 2.

    Each Newton step is one aggregate of gradient, second moments and loss; a step that makes the loss worse is halved. No column may be null.
    """
    k, pen = len(columns), np.array(penalty, dtype=float)
    x, y, w = [F.col(c) for c in columns], F.col(label), F.col(weight)
    up = [(i, j) for i in range(k) for j in range(i, k)]
    beta, move, before = np.zeros(k), np.zeros(k), np.inf
    for _ in range(steps):
        t = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        # one projection for the linear predictor, one aggregate for all sums
        d = rows.withColumn("_t", t).withColumn("_p", 1 / (1 + F.exp(-F.col("_t"))))
        r, h = w * (F.col("_p") - y), w * F.col("_p") * (1 - F.col("_p"))
        loss = w * (F.greatest("_t", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_t"))) - y * F.col("_t"))
        found = d.agg(F.sum(loss), *[F.sum(r * c) for c in x], *[F.sum(h * x[i] * x[j]) for i, j in up]).first()
        if found[0] is None:
            break
        now = float(found[0]) + 0.5 * float((pen * beta ** 2).sum())
        if now > before + 1e-12 * (1 + abs(before)):
            move = move / 2
            beta = beta + move
            continue
        before = now
        grad, hess = np.array(found[1:k + 1], dtype=float) + pen * beta, np.zeros((k, k))
        for (i, j), v in zip(up, found[k + 1:]):
            hess[i, j] = hess[j, i] = v
        move = np.linalg.solve(hess + np.diag(pen + 1e-12), grad)
        beta = beta - move
        if float(grad @ move) < 1e-15 * (1 + abs(now)):
            break
    return beta
