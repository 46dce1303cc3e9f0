"""Line dedup, quality rules, personal data and BPE against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import bpe, line_dedup, personal_data, quality_rules

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def split_words(t):
    return [w for w in re.split("[\x20\x09-\x0D]+", t or "") if w]


def test_line_dedup(odd, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    held = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(AZ)
    for i, t in rows:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    want = Counter()
    for i, t in rows:
        lines = t.split("\n")
        left = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        want[(i, len(lines), len(lines) - len(left), "\n".join(left), "src")] += 1
    out = line_dedup.drop_shared_lines(odd, carry=("source",))
    assert out.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"], "src") for r in out.collect())
    assert got == want and sum(r[2] for r in want) >= 5
    assert line_dedup.drop_shared_lines(empty).count() == 0


def brute_rules(t):
    t = t or ""
    w = split_words(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if split_words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_quality_rules(odd, empty):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules.judged(odd)
    want = Counter((r["doc_id"], *brute_rules(r["text"])) for r in odd.collect())
    assert Counter(tuple(r[c] for c in ["doc_id", *cols]) for r in out.collect()) == want
    assert out.where("kept AND base_failed").count() == 0 and out.where("kept").count() >= 10
    assert quality_rules.judged(empty).count() == 0


def test_rules_table_is_a_parameter(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "# # # # # # # # # # # # #")], "doc_id long, text string")
    rule = quality_rules.Rule("symbols", F.col("n_symbols") / F.col("n_words"), high=0.5)
    got = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in quality_rules.judged(docs, (rule,), max_repeat_percent=100).collect()}
    assert got == {1: (True, []), 2: (False, ["symbols"])}


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in s) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute_spans(t):
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, t or "") if good(k, m.group()))


def test_personal_data(spark, odd, empty):
    texts = ["mail me: a.b@c.d_e@f.g and x@y.z@w.v, a@b.c-d@e.f ok +1 (875) 555-7461.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.255 9.9.9", None, "",
             "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "😀😀 +49 30 1234567 .. é a%b+c@d-e.fr", "password=d3ad1bc945dff9f263 token = \"185d47f3f49afd424713\"",
             "9" * 30000, "+1 " + ". " * 20000, "a" * 30000 + "@", "1-" * 20000 + "1", "a.b" * 9000 + "@" + "x." * 9000 + "y", "5 6 7 8 9 0 1 2 3 4 5 6 7"]
    more = [(i, f"contact {i} u{i}@mail.org, 10.0.{i % 250}.{i % 99}, +1 (555) 010-{1000 + i} or 4111 1111 1111 {1000 + i}") for i in range(100, 200)]
    docs = spark.createDataFrame([*enumerate(texts), *more, (None, "x@y.z"), (3, "")], "doc_id long, text string").withColumnRenamed("x", "v")
    got = {(r["doc_id"], tuple((s["start"], s["o"] - 1, s["kind"], s["end"]) for s in r["found"] if s["base"])) for r in personal_data.personal_data(docs).collect()}
    assert got == {(r["doc_id"], tuple(brute_spans(r["text"]))) for r in docs.collect()}
    out = personal_data.personal_data(odd)
    assert out.count() == odd.select("doc_id", "text").na.fill("", ["text"]).distinct().count()
    assert personal_data.personal_data(empty).count() == 0


def test_personal_data_beyond_the_base(spark):
    """Planted accounts, IBANs, local phones and long secrets are found; dates, versions, counts and failed ones are not."""
    def iban(i):
        body = f"3704004405320{i:05d}"
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    wrong = lambda x: x[:-1] + str((int(x[-1]) + 1) % 10)
    lines = []
    for i in range(400):
        long = hashlib.sha256(str(i).encode()).hexdigest() * 3
        lines += [("account", f"account number {7300000 + i * 7}{i % 90 + 10}", True), ("account", f"phone {200 + i}-{1000 + i}", True), ("iban", f"pay {iban(i)}", True), ("secret", f"token={long}", True),
                  ("account", f"of 20{i % 20 + 10}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", False), ("account", f"of {51000000 + i * 7}", False), ("account", f"v 10.{i % 99 + 10}.{i % 55 + 10}.{i % 77 + 10}.11", False),
                  ("iban", f"pay {wrong(iban(i))}", False), ("base", f"+1 (017) 555-{1000 + i} or 4111 1111 1111 {1000 + i}", None)]
    docs = spark.createDataFrame([(i, x[1]) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: {(s["kind"], r["text"][s["start"]:s["end"]]) for s in r["found"]} for r in personal_data.personal_data(docs).join(docs, "doc_id").collect()}
    right = Counter()
    for i, (kind, text, true) in enumerate(lines):
        if true is not None:
            word = re.split("[ =](?=[^ =]*$)", text)[-1]
            right[kind, true] += any(k == kind and (m == word or m == text) for k, m in got[i]) == true
    assert all(n >= 0.97 * 400 * (1 + (k[0] == "account") * (2 - k[1])) for k, n in right.items()), right


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é x@y.z 😀 1.2.3.4!"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs, personal_data.personal_data(docs)).collect()}
    assert out == {1: "é [email] 😀 [ip]!", 2: ""}


def test_bpe_equals_library(odd, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decoded(bpe.encoded(odd, path, P.PATTERN), path)
    want = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    got = Counter()
    for r in out.collect():
        text = bytes(r["bytes"]).decode()
        ids = library.encode_ordinary(text)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        got[(r["doc_id"], text)] += 1
    assert got == want
    assert bpe.encoded(empty, path, P.PATTERN).count() == 0


def test_bpe_columns_equal_lists():
    """The trees side by side and the single tree give the same ids, at every length."""
    import random

    import public_tokenizers as P

    v = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(5)
    for n in (2, 3, 4, 7, 8, 9, 31, 64):
        pieces = ["".join(r.choice("abeinrst é ") for _ in range(n)).encode()[:n] for _ in range(40)]
        leaves = 1 << (n - 1).bit_length()
        assert [x.tolist() for x in v._merge_equal(pieces, leaves)] == [v._merge_one(p, leaves).tolist() for p in pieces]


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_personal_data_learns_from_every_judged_proposal(spark):
    text = F.concat(F.lit("host "), F.col("id") % 250, F.lit(".1.2.3 and 999."), F.col("id") % 9, F.lit(".0.1"), F.when(F.col("id") % 100 == 0, " ssn 123-45-6789").otherwise(""))
    rows = personal_data.proposals(spark.range(15_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    fit = personal_data.training(rows)
    per = {r["kind"]: (r["n"], r["w"]) for r in fit.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    assert fit.count() == personal_data.judged(personal_data.featured(rows)).count() > 20_000 and per["ip"][0] == 30_000 and per["ssn"][0] == 150
    assert max(w for _, w in per.values()) == pytest.approx(min(w for _, w in per.values()))
