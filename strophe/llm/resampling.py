"""Importance resampling of documents towards a target text collection by hashed word n-grams.

Texts of a batch are joined with a separator that no word can hold; one regular expression finds all words, a
binary search in the document offsets tells whose they are, n-grams that cross documents are masked, and
counting is one ``bincount``. Long texts come in pieces that overlap by the words an n-gram needs,
so a worker holds a bounded blob at a time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import written
from strophe.operators.prefix import ranks, running_totals

#: A word in UTF-8 bytes, once A-Z are lower-cased; the separator is outside of it.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\0"
#: Bytes of a blob.
BLOB = 4 << 20


@dataclass(frozen=True)
class Features:
    """Runs of ``low`` to ``high`` words, in ``buckets`` buckets by crc32."""

    low: int = 1
    high: int = 1
    buckets: int = 10_000


class _Crc(dict):
    """crc32 of words, computed once a word; forgets when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = zlib.crc32(word)
        return value


def pieces(text: bytes, overlap: int, limit: int = BLOB) -> Iterator[tuple[bytes, int]]:
    """(piece, fresh): a text in pieces of about ``limit`` bytes, cut between words. A piece repeats the last ``overlap``
    words of those before it; words from byte ``fresh`` on are new."""
    at, tail = 0, b""
    while len(text) - at > limit:
        cut = at + limit
        # on to the end of the word that stands at the limit
        inside = WORD.match(text, cut)
        cut = inside.end() if inside else cut
        piece = tail + text[at:cut]
        yield piece, len(tail)
        kept = [m.group() for m in WORD.finditer(piece)][-overlap:] if overlap else []
        tail, at = b"".join(w + b" " for w in kept), cut
    yield tail + text[at:], len(tail)


def blobs(texts: list[bytes], overlap: int, limit: int = BLOB) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(blob, offsets, fresh, row): joined pieces with where each starts, where its new words start, and whose it is."""
    parts, fresh, row, size = [], [], [], 0
    for i, text in enumerate(texts):
        for piece, new in pieces(text, overlap, limit):
            if parts and size + len(piece) > limit:
                yield _joined(parts, fresh, row)
                parts, fresh, row, size = [], [], [], 0
            parts.append(piece)
            fresh.append(new)
            row.append(i)
            size += len(piece) + 1
    if parts:
        yield _joined(parts, fresh, row)


def _joined(parts: list[bytes], fresh: list[int], row: list[int]):
    offsets = np.cumsum([0] + [len(p) + len(SEPARATOR) for p in parts[:-1]])
    return SEPARATOR.join(parts), offsets, offsets + np.array(fresh), np.array(row)


def bucketed(texts: list[bytes], features: Features, crc: _Crc) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket, n) of all n-grams of lower-cased texts, a blob and an n at a time."""
    for blob, offsets, fresh, rows in blobs(texts, features.high - 1):
        starts, words = [], []
        for m in WORD.finditer(blob):
            starts.append(m.start())
            words.append(m.group())
        at = np.array(starts, dtype=np.int64)
        owner = np.searchsorted(offsets, at, side="right") - 1
        new = at >= fresh[owner] if len(at) else np.zeros(0, bool)
        codes: list[int] = []
        for n in range(1, features.high + 1):
            codes = [crc[w] for w in words] if n == 1 else [zlib.crc32(b" " + w, c) for c, w in zip(codes, words[n - 1:])]
            if n < features.low or not codes:
                continue
            first, last = owner[:len(codes)], owner[n - 1:]
            own = (first == last) & new[n - 1:]
            yield rows[last[own]], np.array(codes, dtype=np.int64)[own] % features.buckets, n


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(column).to_pylist()]


def profile(df: DataFrame, features: Features = Features(), text: str = "text") -> np.ndarray:
    """Features of all texts per bucket. Every task returns at most one row a bucket, and so does the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = _Crc(), np.zeros(features.buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in bucketed(_texts(batch, 0), features, crc):
                total += np.bincount(bucket, minlength=features.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    counts = df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(features.buckets, dtype=np.int64)
    for r in counts.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored log ratio of every bucket, target against source, add-one smoothed."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, features: Features = Features()) -> DataFrame:
    """doc_id, n_words, n_features, weight: floored mean gain of the features of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = _Crc()
        counted = Features(1, features.high, features.buckets)
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for row, bucket, n in bucketed(_texts(batch, 1), counted, crc):
                size = np.bincount(row, minlength=batch.num_rows)
                if n == 1:
                    words += size
                if n >= features.low:
                    count += size
                    # sums of whole numbers below 2^53 are exact
                    total += np.bincount(row, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int, scale: int = 1000) -> Column:
    """Floored, scaled Gumbel draw from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(scale) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, features: Features = Features(),
              target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of ``docs``; ``rank`` is null for rows not drawn.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) with the highest scores are drawn,
    ties to the smaller id. Null and empty texts have no features and weight 0. Null ids are hashed as an empty
    one and come first in a tie; rows that share id and score are ranked in any order. Other columns are ignored. Empty tables
    give an empty result; without target texts all weights follow the smoothing alone.

    Counts per distinct score decide which scores can be drawn; only those rows are ranked, by digits, never in one task.
    """
    gain = gains(profile(docs, features), profile(target, features, target_text))
    rows = written(weighted(docs, gain, features).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weighted")
    able = rows.where(F.col("n_words") >= min_words)
    cells = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    drawn = total * percent // 100
    lowest = running_totals(cells, [], "score", ["n"]).where(F.col("cum_n") - F.col("n") < drawn).agg(F.min("score")).first()[0] if drawn else None
    none = F.lit(None).cast("long")
    if lowest is None:
        return rows.withColumn("rank", none)
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= lowest)
    ranked = ranks(rows.where(chosen), [], "score", "doc_id").drop("tot_n")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return rows.where(~chosen).withColumn("rank", none).unionByName(ranked.withColumn("rank", rank))
