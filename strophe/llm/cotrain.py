"""Quality classifier by co-training of a text view and a metadata view.

Both views are logistic models fitted by FTRL on a bounded sample of labelled documents. In each
later round a view labels the unlabelled pool where it is confident, and the other view learns
from those labels. A held-back part of the sample calibrates each view and weighs the two; then all
documents are scored row by row, whole texts, without a shuffle. A document is good where its label
says quality 1 and not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import bounded_batches, written
from strophe.llm.ftrl import Ftrl, average
from strophe.llm.quality_views import DIMS, META_DIMS, MetaView, TextView

#: Bounds of the samples, in expectation: labelled rows, rows of the unlabelled pool of a round.
LABELLED, POOL = 16_000, 8_000
SHARDS, ROUNDS = 2, 4
CONFIDENT = 0.97
SETTINGS = {"alpha": 0.3, "l1": 2.0, "l2": 0.1}
VIEWS = {"t": DIMS, "m": META_DIMS}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class QualityModel:
    weights: dict[str, np.ndarray]
    platt: dict[str, tuple[float, float]]
    mix: tuple[float, float, float]

    def score(self, t: float, m: float) -> float:
        """Probability of a good document from the raw scores of the two views."""
        a, b = ((self.platt[v][0] * x + self.platt[v][1]) for v, x in (("t", t), ("m", m)))
        return float(sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept of a small logistic fit by Newton steps."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fields(docs: DataFrame) -> DataFrame:
    has = lambda c, kind: (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(c)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), has("source", "string"), has("lang", "string"), has("n_chars", "long"))


def sampled(docs: DataFrame, labels: DataFrame, labelled: int, pool: int, rounds: int) -> DataFrame:
    """(turn, y, pools, t, m): the samples as vectors. Rows of a pool have a null y, as their labels are not looked at, and list the rounds
    that use them: every round has a pool of its own, all documents where they are few."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") == 1).cast("int").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    y = ((F.col("q") == 1) & (F.col("toxic") == 0)).cast("int")
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) / 1_000_000
    n_labels, n_docs = max(labels.count(), 1), max(docs.count(), 1)
    picked = known.where(draw(21) < labelled / n_labels).select("doc_id", y.alias("y"))
    d = _fields(docs)
    fit = d.join(F.broadcast(picked), "doc_id")  # at most about ``labelled`` rows of two numbers
    turned = lambda k: (draw(22) + k / rounds) % 1.0 < pool / n_docs  # noqa: E731  (disjoint while the pools fit in)
    pools = F.filter(F.array(*[F.when(turned(k), F.lit(k)) for k in range(1, rounds)]), lambda k: k.isNotNull()) if rounds > 1 else F.array().cast("array<int>")
    free = d.withColumn("pools", pools).where(F.size("pools") > 0).join(F.broadcast(picked), "doc_id", "left_anti").withColumn("y", F.lit(None).cast("int"))
    fit = fit.withColumn("pools", F.array().cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = TextView(), MetaView()
        for batch in batches:
            texts, *rest = (c.to_pylist() for c in batch.columns[3:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([text(x).tobytes() for x in texts], pa.binary()),
                                              pa.array([meta(*x).tobytes() for x in zip(*rest, strict=True)], pa.binary())], ["turn", "y", "pools", "t", "m"])

    rows = fit.select(d.columns + ["y", "pools"]).unionByName(free.select(d.columns + ["y", "pools"]))
    rows = rows.select(F.xxhash64(F.lit(23), "doc_id", "text").alias("turn"), "y", "pools", "text", "source", "lang", "n_chars")
    return written(rows.mapInArrow(run, "turn long, y int, pools array<int>, t binary, m binary"), "views")


def _round(rows: DataFrame, states: dict, exchange: bool, shards: int) -> dict:
    """One pass of both views over every shard; a shard holds (labelled + pool) / shards rows."""
    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["turn", "y"], kind="stable")
        x = {v: [np.frombuffer(b, np.int32) for b in pdf[v]] for v in VIEWS}
        y = pdf["y"].to_numpy(np.float64, na_value=np.nan)
        models = {v: Ftrl(n, 1, state=None if states is None else tuple(s.copy() for s in states[v]), **SETTINGS) for v, n in VIEWS.items()}
        targets = {v: y.copy() for v in VIEWS}
        if exchange:
            free = np.isnan(y)
            p = {v: sigmoid(np.array([models[v].weights(i)[:, 0].sum() for i in x[v]])) for v in VIEWS}
            for own, other in (("t", "m"), ("m", "t")):
                sure = free & (np.abs(p[own] - 0.5) >= CONFIDENT - 0.5)
                against = (np.abs(p[other] - 0.5) >= CONFIDENT - 0.5) & ((p[other] > 0.5) != (p[own] > 0.5))
                targets[other][sure & ~against] = (p[own] > 0.5)[sure & ~against]
        one = np.ones(1 << 20)
        for v, model in models.items():
            for i, target, label in zip(x[v], targets[v], y, strict=True):
                if not np.isnan(target):
                    model.learn(i, one[:len(i)], np.array([target]), 1.0 if not np.isnan(label) else 0.5)
        return pd.DataFrame({"v": list(models), "z": [m.z.tobytes() for m in models.values()], "n": [m.n.tobytes() for m in models.values()]})

    got = rows.withColumn("shard", F.pmod("turn", F.lit(shards))).groupBy("shard").applyInPandas(shard, "v string, z binary, n binary").toPandas()
    read = lambda b: np.frombuffer(b, np.float64).reshape(-1, 1)
    if got.empty:
        return {v: (np.zeros((n, 1)), np.zeros((n, 1))) for v, n in VIEWS.items()}
    return {v: average([(read(z), read(n)) for u, z, n in zip(got["v"], got["z"], got["n"], strict=True) if u == v]) for v in VIEWS}


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, shards: int = SHARDS) -> QualityModel:
    """Learns from ``labels`` (doc_id, quality, toxic) of documents. Without labels every document scores 0.5."""
    rows = sampled(docs, labels, labelled, pool, rounds).withColumn("back", F.col("y").isNotNull() & (F.pmod(F.xxhash64("turn"), F.lit(10)) == 0))
    states = None
    for k in range(rounds):
        used = rows.where(~F.col("back") & (F.col("y").isNotNull() | F.array_contains("pools", k)))
        states = _round(used.drop("back", "pools"), states, k > 0, shards)
    weights = {v: Ftrl(n, 1, state=states[v], **SETTINGS).weights()[:, 0] for v, n in VIEWS.items()}
    back = rows.where("back").toPandas()
    y = back["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return QualityModel(weights, {"t": (1.0, 0.0), "m": (1.0, 0.0)}, (1.0, 1.0, 0.0))
    raw = {v: np.array([weights[v][np.frombuffer(b, np.int32)].sum() for b in back[v]]) for v in VIEWS}
    platt = {v: tuple(logistic(raw[v][:, None], y)) for v in VIEWS}
    calibrated = np.column_stack([platt[v][0] * raw[v] + platt[v][1] for v in ("t", "m")])
    return QualityModel(weights, platt, tuple(logistic(calibrated, y)))


def scored(docs: DataFrame, model: QualityModel, carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The columns named in ``carry``, text_score, meta_score (each view's calibrated probability), quality_score
    and accepted (quality_score >= ``threshold``); one row per row of ``docs``.

    A null text is an empty one; missing or null metadata are values of their own. Repeated rows are scored
    alike. Columns not named in ``carry`` are not passed on.
    """
    t, m, platt, score = model.weights["t"], model.weights["m"], model.platt, model.score
    held = {v: (np.flatnonzero(w), w[np.flatnonzero(w)]) for v, w in (("t", t), ("m", m))}
    many = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta, w = TextView(), MetaView(), {v: np.zeros(n) for v, n in VIEWS.items()}
        for v, (at, value) in held.items():
            w[v][at] = value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts, *rest = (c.to_pylist() for c in part.columns[many:])
                a = np.array([w["t"][text(x)].sum() for x in texts])
                b = np.array([w["m"][meta(*x)].sum() for x in zip(*rest, strict=True)])
                q = np.array([score(x, y) for x, y in zip(a, b, strict=True)])
                each = [sigmoid(platt[v][0] * x + platt[v][1]) for v, x in (("t", a), ("m", b))]
                yield pa.RecordBatch.from_arrays([*part.columns[:many], pa.array(each[0]), pa.array(each[1]), pa.array(q), pa.array(q >= threshold)], names)

    names = [*carry, "text_score", "meta_score", "quality_score", "accepted"]
    fields = _fields(bounded_batches(docs))
    own = [docs[c].alias(f"_c{i}") for i, c in enumerate(carry)]
    rest = [c for c in fields.columns if c != "doc_id"]
    has = lambda c, kind: (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(c)
    rows = docs.select(*own, F.coalesce("text", F.lit("")).alias(rest[0]), has("source", "string"), has("lang", "string"), has("n_chars", "long"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"{schema}, text_score double, meta_score double, quality_score double, accepted boolean")
