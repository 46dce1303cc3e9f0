"""Models: held-out accuracy, proper distributions, exact base scores, odd rows; the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from strophe.llm import cotrain, hpy, language_id
from strophe.llm.common import crc_mod
from strophe.llm.ftrl import Ftrl, probabilities, temperature

from .conftest import FIELDS, prose, rows_of
from .test_sets import hits, linked
from .test_texts import AZ, BLANKS

SF = "/root/testdata/sf0.001"


def test_ftrl_learns_sparse_weights():
    r = np.random.default_rng(1)
    model = Ftrl(50, 3, alpha=0.5, l1=1.0, l2=0.1)
    for _ in range(600):
        y = int(r.integers(3))
        model.learn(np.array([y, *r.choice(np.arange(3, 50), 4, replace=False)]), np.ones(5), np.eye(3)[y])
    w = model.weights()
    assert all(w[y].argmax() == y for y in range(3)) and (w[3:] == 0).mean() > 0.5


def test_temperature_softens():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 400)
    logits = np.column_stack((-(2 * y - 1), 2 * y - 1)) * 10.0 * np.where(r.random(400) < 0.8, 1, -1)[:, None]
    t = temperature(logits, y)
    assert 5 < t < 30 and abs(probabilities(logits / t).max(axis=1).mean() - 0.8) < 0.02


def test_language_id(spark, odd, empty):
    out = language_id.identified(odd, language_id.trained(odd.where(crc_mod(F.col("doc_id"), 3) != 1)))
    rows = out.join(odd.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    long = [r for r in rows if r["doc_id"] >= 40]
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in long)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 12))
    assert out.count() == odd.count()
    nothing = language_id.trained(empty)
    assert {r["lang_pred"] for r in language_id.identified(odd, nothing).collect()} == {"und"}
    assert language_id.identified(empty, nothing).count() == 0


def test_language_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 1
    wrong = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = (language_id.identified(d, language_id.trained(d.where(~held))) for d in (docs, wrong))
    assert a.exceptAll(b).count() == 0
    both = a.join(docs.select("doc_id", "lang"), "doc_id").where(held)
    assert both.where("lang_pred = lang").count() >= 0.97 * both.count()


def test_language_model(spark, odd, empty):
    train = odd.where(crc_mod(F.col("doc_id"), 7) != 2)
    out = {(r["doc_id"], r["n_tokens"]): r for r in hpy.scored(odd, hpy.train(train)).collect()}
    words = lambda t: [*[w for w in (t or "").translate(AZ).encode().split()], b""]
    counts = Counter()
    for r in train.collect():
        counts.update(words(r["text"]))
    n, v = sum(counts.values()), len(counts)
    assert len(out) == odd.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count() - 1  # one id has two texts of equal length
    for r in odd.collect():
        w = words(r["text"])
        got = out[(r["doc_id"], len(w))]
        assert got["train_tokens"] == n and got["score"] < 0
        if r["doc_id"] != 7:
            assert got["n_known"] == sum(counts[x] > 0 for x in w)
            assert math.isclose(got["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    assert hpy.scored(odd, hpy.train(empty)).where("score = 0 AND base_score = 0 AND n_known = 0").count() == len(out) + 1
    assert hpy.scored(empty, hpy.train(train)).count() == 0


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 7) == 2
    for bounds in ({}, {"heavy_words": 300, "contexts": 40, "dishes": 500}):
        model = hpy.train(docs.where(~held), **bounds)
        heavy = set(model.heavy.tolist())
        assert len(heavy) <= 100_000 and len(model.backoff) <= 2000
        root = model.parent.sum() + model.unknown + sum(r["p"] for r in model.table.collect() if r["h"] not in heavy)
        assert math.isclose(root, 1.0, rel_tol=1e-6)
        own = np.bincount(model.codes // len(heavy), model.own, minlength=len(model.backoff))
        assert np.allclose(own + model.backoff, 1.0, atol=1e-9)
        sums = hpy.scored(docs, model).where(held).agg(F.sum("score"), F.sum("base_score")).first()
        assert sums[0] > sums[1]


def test_language_model_keeps_every_context(spark):
    """Rare previous words have restaurants too, and the bounds of the cache do not change a score."""
    text = lambda i: " ".join(f"rare{i % 50} next{i % 50} w{j % 7}" for j in range(3))
    docs = spark.createDataFrame([(i, text(i) if i % 2 else "filler word " * 40) for i in range(400)], "doc_id long, text string").repartition(3)
    small = hpy.train(docs, heavy_words=20, contexts=5, dishes=10)
    assert len(small.heavy) <= 20 and small.contexts <= 5 and len(small.codes) <= 10
    pairs = Counter()
    for r in docs.collect():
        w = [b"", *r["text"].encode().split(), b""]
        pairs.update(zip(w, w[1:]))
    shares = {(r["u"], r["w"]): r for r in small.shares.collect()}
    words = {r["h"]: r for r in small.table.collect()}
    digest = hpy.Codes(np.zeros(0, np.int64))
    assert {k: r["c"] for k, r in shares.items()} == {tuple(digest(list(k)).tolist()): c for k, c in pairs.items()}
    left = dict.fromkeys(words, 0.0)
    for (u, _), r in shares.items():
        left[u] += r["own"]
    assert all(math.isclose(left[u] + r["b"], 1.0, rel_tol=1e-9) for u, r in words.items())
    u, w = digest([b"rare1", b"next1"]).tolist()
    assert shares[u, w]["own"] + words[u]["b"] * words[w]["p"] > 0.9
    out = {r["doc_id"]: r["score"] for r in hpy.scored(docs, small).collect()}
    for r in docs.where("doc_id < 20").collect():
        w = digest([b"", *r["text"].encode().split(), b""]).tolist()
        p = [shares[x]["own"] + words[x[0]]["b"] * words[x[1]]["p"] for x in zip(w, w[1:])]
        assert math.isclose(out[r["doc_id"]], sum(map(math.log10, p)), rel_tol=1e-9)


def test_seating():
    rng = np.random.default_rng(4)
    t = hpy.seat(np.array([0, 1, 2, 10, 100_000]), 1e-9, 0.5, rng)
    assert t[:2].tolist() == [0, 1] and t[2:].tolist() == [1, 1, 1]
    many = hpy.seat(np.full(20_000, 3), np.full(20_000, 1.0), 0.5, rng)
    # one table, then opened with 1 / 1.5 and 1 / (3 - 0.5 t) in turn
    second = 1 / 1.5
    assert abs(many.mean() - (1 + second + second * 1 / 2 + (1 - second) * 1 / 2.5)) < 0.02


def test_quality_cotraining(spark, odd, empty):
    r, pairs, labels = random.Random(3), [], []
    for i in range(700):
        kind = i % 7
        text = prose(5000 + i, 60)
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            w = text.split()
            w.insert(r.randrange(len(w)), "vileword")
            text = " ".join(w)
        pairs.append((i, text, "en", "good" if r.random() < (0.9 if kind not in (1, 2) else 0.2) else "bad"))
        labels.append((i, int(kind != 1), int(kind == 2), "x"))
    docs = spark.createDataFrame(rows_of(pairs), FIELDS).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 0, "x"), (5, None, None, "x"), (9999, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    model = cotrain.trained(docs, known.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    out = {x["doc_id"]: x for x in cotrain.scored(docs, model, carry=("doc_id", "kept")).collect()}
    odd_ids = [i for i in range(700) if i % 2]
    right = sum(out[i]["accepted"] == (i % 7 not in (1, 2)) for i in odd_ids)
    assert right >= 0.95 * len(odd_ids) and all(0 <= x["quality_score"] <= 1 for x in out.values())
    assert cotrain.scored(odd, model).count() == odd.count()
    assert cotrain.scored(empty, model).count() == 0
    assert cotrain.scored(docs.select("doc_id", "text"), model).count() == 700
    blank = cotrain.trained(docs, known.where("false"))
    assert cotrain.scored(docs, blank).where("quality_score <> 0.5").count() == 0


def test_pipeline(spark, tmp_path):
    """Stages 2 to 5 against plain Python on what the first stage kept; the stages' columns."""
    import corpus_pipeline as p
    import public_tokenizers as P
    import tiktoken

    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality(spark, docs, SF)
    assert kept.columns == list(p.COLUMNS)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("quality = 1 AND toxic = 0")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.join(docs, "doc_id", "left_semi").count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    held = {}
    key = lambda line: line.strip(BLANKS).translate(AZ)
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    rows = [(i, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i)) for i, t in rows]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, linked(rows), strict=True) if c == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not hits(t, items)[3]]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows for ids in [library.encode_ordinary(t)]}
    got = {tuple(r) for r in p.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == want
