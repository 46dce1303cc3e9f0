"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strophe.llm import resampling
from strophe.llm.resampling import Features


def words_of(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def codes_of(t, f):
    w = words_of(t)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % f.buckets for n in range(f.low, f.high + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, f, percent=10, min_words=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(codes_of(text, f))
    for text in target:
        t.update(codes_of(text, f))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + f.buckets) / ((s[b] + 1) * (big_t + f.buckets))))
    out = []
    for i, text in rows:
        c = codes_of(text, f)
        weight = sum(map(gain, c)) // len(c) if c else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words_of(text)), len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return out, [(r[4], r[0]) for r in drawn]


@pytest.mark.parametrize("f", [Features(), Features(1, 2, 500), Features(2, 3, 97)])
def test_resampling(spark, odd, f):
    target = ["the of and Th on ing whea", None, "", "É é 漢字 漢字 漢字", "a b c d e f g"] * 3
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, drawn = brute(rows, target, f, 30)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int").repartition(2)
    out = resampling.resampled(odd, items, percent=30, features=f).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in out) == Counter(want)
    got = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1)) and len(drawn) > 3
    assert [(r["score"], r["doc_id"]) for r in got] == drawn


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(empty, none).count() == 0
    assert resampling.resampled(odd, none).count() == odd.count()
    few = odd.where("doc_id = 4")
    assert [r["rank"] for r in resampling.resampled(few, none).collect()] == [None]


def test_pieces_lose_and_double_nothing():
    """Blobs of a few bytes give the n-grams of whole texts, also across cuts, and none across documents."""
    texts = [b"aa bb cc dd ee ff gg hh ii", b"", b"x" * 50, b" ".join(b"w%d" % i for i in range(90)), b"\0one\0two\0", "é 漢字 é".encode()]
    for limit in (1, 3, 7, 20, 1000):
        for n in (1, 2, 3):
            got = Counter()
            for blob, offsets, fresh, rows in resampling.blobs(texts, n - 1, limit):
                starts = np.array([m.start() for m in resampling.WORD.finditer(blob)], dtype=np.int64)
                words = [m.group() for m in resampling.WORD.finditer(blob)]
                owner = np.searchsorted(offsets, starts, side="right") - 1
                for i in range(len(words) - n + 1):
                    if owner[i] == owner[i + n - 1] and starts[i + n - 1] >= fresh[owner[i]]:
                        got[(rows[owner[i]], b" ".join(words[i:i + n]))] += 1
            want = Counter((k, b" ".join(w[i:i + n])) for k, t in enumerate(texts) for w in [resampling.WORD.findall(t)] for i in range(len(w) - n + 1))
            assert got == want
