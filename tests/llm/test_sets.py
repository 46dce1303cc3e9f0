"""Benchmark search, near duplicates, components and WARC against plain Python."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from strophe.llm import decontaminate, part_enum, warc
from strophe.llm.common import scratch
from strophe.llm.components import components

from .conftest import FIELDS, prose, rows_of
from .test_texts import AZ, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items):
    w = WORD.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall((t or "").translate(AZ))
        size = min(13, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark, odd, empty):
    long_item, short = prose(500, 40), "Zeta eta THETA iota"
    items = [(1, long_item), (2, short), (3, None), (4, "  "), (5, "zeta eta theta"), (6, long_item), (10, "é É 漢字 1 2"), (11, "never seen at all"), (12, "a a a a a a a a a a a a a a a")]
    w = long_item.split()
    texts = ["x " + " ".join(w[3:25]) + " y", " ".join(w[:12]), " ".join(w[:13]).upper(), "zeta, eta\ntheta iota zeta eta theta!", None, "", "q " * 300 + short,
             "a " * 40, "é É 漢字 12 1", " ".join(w) + " " + " ".join(w), " ".join(w[:20] + w[10:30]), "zeta eta"]
    docs = spark.createDataFrame(rows_of([(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, short, "en", "s")]), FIELDS)
    bench = spark.createDataFrame([(*x, 1, "z") for x in items], "item_id long, text string, term int, _t string")
    for table in (docs, odd):
        got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.contamination(table, bench).collect()}
        want = set()
        for r in table.collect():
            a, b, c, d = hits(r["text"], items)
            want.add((r["doc_id"], a, b, tuple(c), d))
        assert got == want
    assert decontaminate.contamination(empty, bench).count() == 0
    # texts that share an item id all count, as do items without an id; ids are listed once
    shared = spark.createDataFrame([(2, short), (2, "q q q"), (2, "q q q"), (None, "alone words here"), (None, None)], "item_id long, text string")
    some = spark.createDataFrame([(1, "x " + short + " q q q q"), (2, "so alone words here"), (3, "none of it")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(some, shared).collect()}
    assert got == {1: (8, ["2"], True), 2: (3, [], True), 3: (0, [], False)}
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Alpha beta gamma")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["span"]) for r in decontaminate.proximity_hits(docs, bench, 8).collect()}
    assert {g[0] for g in got} == {1, 3} and (3, 7, 2) in got


def shingles(text):
    w = split_words((text or "").translate(AZ))
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def linked(rows, percent=80):
    """component of each position by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(words, r, edits):
    w = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(w)), r.random()
        if kind < 0.4:
            w[at] = "w" + str(r.randrange(10 ** 6))
        elif kind < 0.7 and len(w) > 1:
            del w[at]
        else:
            w.insert(at, "n" + str(r.randrange(10 ** 6)))
    return " ".join(w)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates(spark, monkeypatch, block):
    """Chains, stars and boundary pairs of many sizes; also where groups are larger than a block."""
    monkeypatch.setattr(part_enum, "BLOCK", block)
    r, rows = random.Random(block), []
    for n in (1, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 130, 200, 320, 500):
        base = prose(900 + n, n).split()
        for e in (0, 0, 1, 1, 2, 3, max(1, n // 60), max(1, n // 50), max(1, n // 40), max(1, n // 30)):
            rows.append((len(rows) + 5, edited(base, r, e)))
    hub = prose(77, 100).split()
    rows += [(1000 + i, edited(hub, r, 2)) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "  "), (1001, rows[3][1].upper()), (5, rows[0][1])]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows_of([(d, t, "en", "s") for d, t in rows]), FIELDS).repartition(3)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in part_enum.near_duplicate_classes(docs).collect())
    # rows that share an id are one vertex only through their texts
    assert got == sorted(linked(rows))


def test_near_duplicates_odd(odd, empty):
    out = part_enum.near_duplicate_classes(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[5] == by[6] == 5 and by[8] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {5, None}
    assert part_enum.near_duplicate_classes(empty).count() == 0


def test_unrelated_sets_of_a_group_are_done_after_one_round(spark, monkeypatch):
    """Groups of sets that share a signature but are beyond the bound go to no later round; of a cluster among them only its followers do."""
    r = np.random.default_rng(8)
    cluster = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [r.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(60)] + [np.concatenate((cluster[5:], r.integers(0, 1 << 63, 5, dtype=np.uint64))) for _ in range(4)]
    rows = [(g, i, i, i, len(s), bytearray(part_enum.sketch(s))) for g in (1, 2) for i, s in enumerate(sets) if g == 1 or i < 60]
    for block in (2048, 16):
        monkeypatch.setattr(part_enum, "BLOCK", block)
        out = part_enum._pairs(spark.createDataFrame(rows, "g long, id long, k1 long, c long, n long, sketch binary"), 80, "star").collect()
        pairs = {(min(x["a"], x["b"]), max(x["a"], x["b"])) for x in out if x["g"] is None}
        left = {}
        for x in out:
            if x["g"] is not None:
                left.setdefault(x["g"], set()).add(x["a"])
        close = {(i, j) for i in range(60, 64) for j in range(i + 1, 64)}
        # every untried pair goes on inside one group, and nobody without one
        assert pairs <= close and len(pairs) >= 3
        assert all(any({*p} <= ids for ids in left.values()) for p in close - pairs)
        assert set().union(*left.values()) <= {60, 61, 62, 63}


def test_signatures_are_shared():
    """Every pair at the very threshold shares a signature, over many sizes (random cuts leave none out)."""
    r = np.random.default_rng(3)
    for n in [*range(1, 60), 80, 120, 200, 300, 700, 2000]:
        for _ in range(6):
            union = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = len(union) * 20 // 100
            gone = r.permutation(len(union))[:drop]
            side = r.integers(0, 3)
            a = np.delete(union, gone if side == 0 else gone[:drop // 2])
            b = union if side == 0 else np.delete(union, gone[drop // 2:])
            assert np.intersect1d(part_enum.signatures(a, 80), part_enum.signatures(b, 80)).size, n


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 30)] + [(300, 300), (7, None)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 30)) and got[300] == 300


def test_warc(spark, monkeypatch):
    big = "<p>" + "x" * 400_000
    pages = [(3, "http://a", "same"), (1, "http://b\n", "same"), (2, None, big), (4, "http://c", None), (5, "http://d", ""), (6, "http://é", "é\r\n\r\nWARC/1.1\r\n"),
             (None, "http://e", "same"), (None, "http://e", "alone"), (1, "http://b\n", "same"), (9, "u", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, revisit int").repartition(3)
    root = scratch(spark, "test")
    index = warc.write_bundles(df, root, frame_bytes=1000)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(spark, index, root).collect()), key=str)
    least = {"same": "1", big: "2", "": "4"}
    want = []
    for p, _, t in pages:
        raw = (t or "").encode()
        owner = least.get(t or "")
        revisit = owner is not None and str(p) != owner
        want.append((None if p is None else str(p), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    assert got == sorted(want, key=str)
    row = index.where("record_id = 'urn:page:2'").first()
    assert warc.read_record(root, row["bundle"], "urn:page:2")["payload"] == big.encode()
    import zstandard
    from pyarrow import fs
    where, base = fs.FileSystem.from_uri(root)
    with where.open_input_file(f"{base}/{row['bundle']}") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == index.where(f"bundle = '{row['bundle']}'").count()
    for width in (str(index.select("bundle").distinct().count()), "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            assert warc.read_bundles(spark, index, root).rdd.getNumPartitions() == 1
            many = monkeypatch.setattr(warc, "READ_BYTES", 100) or warc.read_bundles(spark, index, root)
            total = index.select("bundle", "frame", "frame_bytes").distinct().agg({"frame_bytes": "sum"}).first()[0]
            assert many.rdd.getNumPartitions() == -(-total // 100) > 3 and many.count() == len(pages)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            monkeypatch.undo()
    small = warc.read_bundles(spark, warc.write_bundles(df, root, min_bytes=5), root)
    assert small.where("page_id = '3'").first()["record_type"] == "response"
    assert warc.read_bundles(spark, warc.write_bundles(df.where("false"), root), root).count() == 0
