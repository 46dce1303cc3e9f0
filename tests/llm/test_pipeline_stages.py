"""Every pipeline stage on odd documents and on an empty table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp

from .conftest import FIELDS, prose, rows_of

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in df.collect())


def test_stages_keep_what_they_should(spark, odd):
    docs = as_rows(odd)
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        if stage is cp.tokens:
            assert out.count() == odd.count() and out.where("n_tokens = 0").count() == odd.where("text IS NULL OR text = ''").count()
            continue
        assert out.columns == list(cp.COLUMNS), name
        got = as_rows(out)
        if stage is cp.lines:
            assert sum(got.values()) == odd.count() and sum(t is None for _, t, _, _ in got) == 0
        else:
            assert all(n == docs[k] for k, n in got.items()), name  # rows repeated whole share one fate
        if stage is cp.benchmark:
            assert got == docs
        if stage is cp.near_duplicates:
            gone = Counter(k[0] for k in (docs - got).elements())
            assert set(gone) == {6, 8} and gone[6] == 2  # copies of document 5; rows without an id or words stay


def test_stages_on_an_empty_table(spark, empty):
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_a_unique_text_outlives_its_id(spark):
    base = prose(900, 200)
    pairs = [(1, base, "en", "a"), (2, base, "en", "b"), (2, prose(901, 200), "en", "c"), (3, base, "en", "d")]
    docs = spark.createDataFrame(rows_of(pairs), FIELDS)
    kept = {(r["doc_id"], r["source"]) for r in cp.near_duplicates(spark, docs, SF).collect()}
    assert kept == {(1, "a"), (2, "b"), (2, "c")}
