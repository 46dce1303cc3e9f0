"""Fail-closed behaviour: leaks, freezing, coverage, sources and sinks, text rules, leak-free folds."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.functions import hooks
from strophe.functions import texts as tx
from strophe.functions.inventory import ALLOPHONES, DROPPED_LABELS, PHONES
from strophe.operators import association as ac
from strophe.operators import contracts as ct
from strophe.operators import linking as lk
from strophe.plans import foldrun as fr
from strophe.plans import q_models as qm
from strophe import session
from strophe.session import shared_dir
from strophe.sources import records as rc
from strophe.sources.frames import duplicate_frames


def scratch(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_text_rules(spark):
    assert one(spark, "  a b\t\n c ", tx.normalize_text) == "a b c"
    reasons = {"xxx": "empty_or_noise", "[say ee]": "elicitation_instruction", "see pic.JPG now": "picture_prompt", "123": "no_english_letters", "hello": None}
    for text, want in reasons.items():
        assert one(spark, text, tx.text_reason) == want
    assert one(spark, "Don’t re-do it!", tx.words) == ["don't", "re-do", "it"]
    assert one(spark, "A/c", tx.grade_score) == 2.0 and one(spark, "z", tx.grade_score) is None
    assert one(spark, "M05", tx.group_prefix) == "M" and one(spark, "M05x", tx.group_prefix) is None
    sym = lambda c: tx.normalize_symbol(c, DROPPED_LABELS, ALLOPHONES, [*PHONES, "AX", "DX"])
    assert tuple(one(spark, "ax-h2", sym)) == ("AX", "ok") and tuple(one(spark, "TCL", sym)) == (None, "dropped") and one(spark, "qq", sym)["status"] == "unknown"
    ipa = one(spark, ["ˈɔːɹ", "aɪɚ", "tʃ", "xx", "ə"], tx.map_ipa_tokens, "array<string>")
    assert ipa["symbols"] == ["AO", "R", "AY", "ER", "CH", "AH"] and ipa["unknown"] == ["xx"]


def test_ids_are_canonical_json_hashes(spark):
    df = ct.runtime_ids(spark.createDataFrame([("g\"1", 7, 0, "AA")], "grp string, event long, idx int, target string"), "grp", "event", "idx", "target", "ns")
    r = df.first()
    body = json.dumps({"kind": "utt", "namespace": "ns", "parts": ["g\"1", 7], "scheme": "local_deterministic_sha256.v1"}, sort_keys=True, separators=(",", ":")) + "\n"
    assert r["recording_ref"] == "utt_" + hashlib.sha256(body.encode()).hexdigest()[:20]


def test_decisions_fail_closed(spark):
    rows = [(0.2, 0.9, 0.5, "K", "T"), (0.9, 0.9, 0.5, "K", "T"), (0.9, 0.9, 0.5, "<DEL>", "T"), (0.9, 0.9, 0.01, "K", "T"), (0.9, 0.9, 0.5, "T", "T"), (None, 0.9, 0.5, "K", "T")]
    df = spark.createDataFrame(rows, "p_error double, p_alt double, margin double, top_alt string, target string")
    assert [r["decision"] for r in ct.decision_record(df, 0.8).collect()] == [
        "correct", "substitution", "deletion", "atypical_unspecified", "atypical_unspecified", "abstain"]
    assert {r["decision"] for r in ct.decision_record(df, None).collect()} == {"correct", "atypical_unspecified", "abstain"}


def test_leaks_are_found_at_any_depth(spark):
    df = spark.createDataFrame([("C:\\data", [(1,)])], "note string, items array<struct<gold_label:int>>")
    found = {(r["field"], r["finding"]) for r in ct.leak_report(df, {"raw_path": r"[A-Za-z]:[\\/]"}).collect()}
    assert found == {("note", "raw_path"), ("items[].gold_label", "forbidden_name")}


def test_coverage_reports_never_intersect_silently(spark):
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 2)], "method string, key long")
    expected = spark.createDataFrame([(1,), (2,)], "key long")
    got = {tuple(r) for r in lk.coverage_gaps(have, expected, "method", ["key"], ["a", "b"]).collect()}
    assert got == {(2, "b", "missing"), (3, "b", "extra"), (2, "c", "extra")}


def test_pairs_are_distinct_and_groups_weigh_the_same(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("grp"), F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    pairs = lk.pair_sample(df, "grp", "key", "label", 64).collect()
    assert len({(r["positive"], r["negative"]) for r in pairs}) == len(pairs) == 128
    assert sum(r["weight"] for r in pairs) == pytest.approx(1)
    assert all(r["positive"] % 7 == 0 and r["negative"] % 7 for r in pairs)


def test_jsonl_quarantine_and_csv(spark):
    path = scratch(spark)
    spark.createDataFrame([('{"a": 1}',), ("",), ("[1]",), ('{"a": ',), ('{"a": "x"}',)], "value string").coalesce(1).write.text(path)
    good, bad = rc.read_jsonl(spark, path, "a bigint")
    assert [r["a"] for r in good.collect()] == [1]
    assert sorted(r["reason"] for r in bad.collect()) == ["blank_line", "invalid_json", "invalid_json", "not_an_object"]
    with pytest.raises(ValueError, match="without rows"):
        rc.write_csv(spark.range(0), scratch(spark))


def test_frozen_predictions(spark):
    path = scratch(spark)
    df = spark.range(5).withColumn("p", F.col("id") * 2)
    with pytest.raises(ValueError, match="gold"):
        fr.freeze(df.withColumn("gold_error", F.lit(1)), path, ["id"])
    with pytest.raises(FileNotFoundError):
        fr.load_frozen(spark, path, ["id", "p"])
    fr.freeze(df, path, ["id", "p"])
    assert fr.load_frozen(spark, path, ["id", "p"]).count() == 5
    df.limit(1).write.mode("append").parquet(f"{path}/predictions")
    with pytest.raises(ValueError, match="differ"):
        fr.load_frozen(spark, path, ["id", "p"])


def test_shared_folder_is_required_off_local_mode(spark):
    assert shared_dir(spark) and spark.sparkContext.getCheckpointDir() is not None
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[3,2,1000]")
    assert not session.is_local("yarn") and not session.is_local("spark://host:7077")

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_lines_with_more_than_an_object_are_quarantined(spark):
    lines = ['{"a": 1}', '{"a": 2}{"a": 3}', '{"a": 1} junk', '{"a": 4, "b": "} {\\" x"}', '  {"a": 5}  ', '{"a": {"c": [1, {"d": 2}]}}', '{"a": 6},', '{"a": 7}}', '{"a": 8', '']
    path = scratch(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = rc.read_jsonl(spark, path, "a string, b string")
    assert sorted(r["a"] for r in good.collect()) == ["1", "4", "5", '{"c":[1,{"d":2}]}'] or sorted(r["a"] for r in good.collect())[:3] == ["1", "4", "5"]
    assert {r["value"] for r in bad.collect()} == {lines[1], lines[2], lines[6], lines[7], lines[8], lines[9]}


def test_structural_checks(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [True]), (2, ["a"], [True])], "event long, symbols array<string>, mask array<boolean>")
    assert [r["event"] for r in ct.unequal_lengths(rows, ["event"], ["symbols", "mask"]).collect()] == [1]
    holes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 0)], "event long, idx long")
    assert sorted(r["event"] for r in ct.index_holes(holes, ["event"], "idx").collect()) == [2, 3]
    meta = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("h", 1, "y")], "grp string, sev int, site string")
    assert [tuple(r) for r in ac.inconsistent_metadata(meta, ["grp"], ["sev", "site"]).collect()] == [("g", "sev")]
    twice = spark.createDataFrame([(1, 0, [0.0]), (1, 0, [1.0]), (1, 1, [0.0])], "event long, frame long, logits array<double>")
    assert [tuple(r) for r in duplicate_frames(twice).collect()] == [(1, 0, 2)]


def test_mapper_calls_are_bounded(spark):
    texts = pa.array(["a" * 10, None, "b" * 30, "c" * 5, "d" * 5, "", "é" * 200])
    assert list(hooks.slices(texts, 20)) == [(0, 2), (2, 1), (3, 3), (6, 1)] and list(hooks.slices(pa.array([], pa.string()), 20)) == []
    most = spark.sparkContext.accumulator(0)

    def mapper(batch):
        most.add(int(sum(map(len, batch)) > hooks.CALL))
        return [list(t) for t in batch], [[] for _ in batch]

    df = spark.range(3000).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1000)).alias("t")).unionByName(spark.createDataFrame([(None,), ("",)], "t string"))
    got = hooks.map_texts(df.repartition(1), "t", mapper).select("t", F.size("symbols").alias("n"), F.size("unknown").alias("u")).collect()
    assert len(got) == 3002 and all(r["n"] == len(r["t"] or "") and r["u"] == 0 for r in got) and most.value == 0


def test_word_counts_of_repeated_and_null_keys(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["x"]), (2, ["x", "yy"]), (3, []), (4, None), (None, ["q"]), (None, ["q", "r"]), (5, []), (5, ["z"])]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = {r["k"]: tuple(r)[1:] for r in tx.word_counts(df, "k", "w").collect()}
    assert got == {1: (3, 2, "a", "b", 6), 2: (3, 2, "x", "yy", 6), None: (3, 2, "q", "r", 4), 5: (1, 1, "z", "z", 1)}
