"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training document. The weights are fitted by FTRL with an
elastic net on a bounded sample of labelled rows (``sample`` rows, spread evenly over the languages),
in shards whose states are averaged every round; a tenth of the sample is held back for the
temperature. Prediction reads whole texts, row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.char_ngrams import DIMS, counted
from strophe.llm.common import bounded_batches, written
from strophe.llm.ftrl import Ftrl, average, probabilities, temperature

SAMPLE = 16_000
SHARDS = 8
ROUNDS = 3
MAX_LANGUAGES = 512


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(b, df): documents that hold each bucket; one row per bucket and task before the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[counted(text)[0]] += 1
        b = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(df[b])], ["b", "df"])

    return bounded_batches(docs).select("text").mapInArrow(run, "b long, df long").groupBy("b").agg(F.sum("df").alias("df"))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length: (1 + log tf) * idf."""
    index, count = counted(text)
    value = (1.0 + np.log(count)) * idf[index]
    return index, value / max(np.sqrt(value @ value), 1e-12)


def trained(docs: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS, alpha: float = 2.0,
            l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel:
    """Learns from rows with text and lang. At most ``sample`` rows (in expectation), at most MAX_LANGUAGES languages
    (else an error). Rows are drawn by a hash of id and text, so equal inputs give equal samples."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").take(MAX_LANGUAGES + 1)}
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not per:
        return LanguageModel([], np.ones(DIMS), np.zeros((DIMS, 0)), 1.0)
    languages, total = list(per), sum(per.values())
    df = document_frequencies(known).toPandas()  # at most DIMS rows
    idf = np.full(DIMS, np.log(1.0 + total))
    idf[df["b"].to_numpy(np.int64)] = np.log((1.0 + total) / (1.0 + df["df"].to_numpy())) + 1.0
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    chance = F.lit(0.0)
    for lang, n in per.items():
        chance = F.when(F.col("lang") == lang, F.lit(sample / len(per) / n)).otherwise(chance)
    label = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    picked = known.where(draw < chance).select(
        "text", label.alias("label"), F.xxhash64(F.lit(12), "doc_id", "text").alias("turn"))
    rows = written(picked.mapInArrow(_features(idf), "label int, turn long, i binary, v binary"), "sample")
    rows = rows.withColumn("shard", F.pmod("turn", F.lit(shards * 10)).cast("int"))
    fit, held = rows.where(F.col("shard") < shards * 9), rows.where(F.col("shard") >= shards * 9)
    state = None
    for _ in range(rounds):
        state = _round(fit.withColumn("shard", F.pmod("shard", F.lit(shards))), len(languages), state, alpha, l1, l2)
    weights = Ftrl(DIMS, len(languages), alpha, l1=l1, l2=l2, state=state).weights().astype(np.float32)
    back = held.toPandas()
    logits = np.array([np.frombuffer(v, np.float32) @ weights[np.frombuffer(i, np.int32)] for i, v in zip(back["i"], back["v"], strict=True)])
    return LanguageModel(languages, idf, weights, temperature(logits.reshape(len(back), len(languages)), back["label"].to_numpy(np.int64)))


def _features(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t, idf) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
                                              pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["label", "turn", "i", "v"])
    return run


def _round(fit: DataFrame, classes: int, state, alpha: float, l1: float, l2: float):
    """One pass of every shard; a shard holds sample / shards rows."""
    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["turn", "label"], kind="stable")
        start = None if state is None else (state[0].copy(), state[1].copy())
        model = Ftrl(DIMS, classes, alpha, l1=l1, l2=l2, state=start)
        one = np.eye(classes)
        for i, v, y in zip(pdf["i"], pdf["v"], pdf["label"], strict=True):
            model.learn(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64), one[y])
        return pd.DataFrame({"z": [model.z.astype(np.float32).tobytes()], "n": [model.n.astype(np.float32).tobytes()]})

    got = fit.groupBy("shard").applyInPandas(shard, "z binary, n binary").toPandas()
    read = lambda b: np.frombuffer(b, np.float32).reshape(DIMS, classes).astype(np.float64)
    if got.empty:
        return np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    return average([(read(z), read(n)) for z, n in zip(got["z"], got["n"], strict=True)])


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score; one row per row of ``docs``.

    ``und`` with score 0 where the text is null or holds no letter, or nothing was learned.
    Repeated rows, null ids and ties (the first language by name) come out as they are; other columns are ignored.
    """
    languages, idf, weights, t = [*model.languages, "und"], model.idf.astype(np.float32), model.weights, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is not None and len(languages) > 1:
                    i, v = vector(text, idf)
                    p = probabilities((v @ weights[i]) / t) if weights.shape[1] > 1 else np.ones(1)
                    best[k], score[k] = int(p.argmax()), float(p.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([languages[b] for b in best], pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    lettered = docs.select("doc_id", F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"))
    return lettered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
