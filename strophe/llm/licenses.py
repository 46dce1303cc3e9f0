"""License scan by ordered signature rules (DataFrame functions only, no shuffle).

A text becomes its words, each between two blanks of its own, so that a pattern of words needs no look
around. Only rules whose keyword is among the words are matched. Overlaps
are resolved by containment: a match inside one of a stronger tier, or inside a longer one of the same tier, goes.
Everything stays in the document's row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import let, lower_az
from strophe.llm.license_rules import CONFIDENCE, RULES, Rule, compiled

#: Everything outside words, once A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_RULE = "array<struct<label:string,tier:int,keyword:string,pattern:string,base:boolean,at:int>>"
_MATCH = "array<struct<start:int,back:int,tier:int,at:int,label:string,base:boolean>>"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def normal_form(found: Column) -> Column:
    """Words, each between two blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def word_count(normal: Column) -> Column:
    """Words of (a piece of) a normal form."""
    return ((F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))) / 2).cast("int")


def running(a: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """Inclusive running ``op`` of an array of ``kind``, by blocks of the square root of its length: never quadratic."""
    def cut(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        return let(size, lambda b: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / b).cast("int") - 1), lambda j: F.slice(x, j * b + 1, b)))

    def lifted(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda x: F.aggregate(x, zero, op)), lambda t: F.flatten(F.transform(blocks, lambda x, j: let(
            F.aggregate(F.slice(t, F.lit(1), j), zero, op),
            lambda base: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i + 1), base, op))))))

    return let(a, lambda x: F.when(F.size(x) == 0, F.array().cast(f"array<{kind}>")).otherwise(let(cut(x), lifted)))


def _located(normal: Column, rule: Column) -> Column:
    """Matches of a rule as (start, -end, tier, at, label, base) in words, end exclusive."""
    def placed(hits: Column) -> Column:
        pieces = F.transform(F.split(normal, rule["pattern"], -1), word_count)
        sizes = F.transform(hits, word_count)

        def starts(p: Column, s: Column) -> Column:
            steps = F.transform(s, lambda _, i: F.get(p, i) + F.coalesce(F.get(s, i - 1), F.lit(0)))
            return let(running(steps, F.lit(0), lambda x, y: x + y), lambda at: F.transform(s, lambda n, i: F.struct(
                F.get(at, i).alias("start"), (-F.get(at, i) - n).alias("back"), rule["tier"].alias("tier"), rule["at"].alias("at"),
                rule["label"].alias("label"), rule["base"].alias("base"))))

        return let(pieces, lambda p: let(sizes, lambda s: starts(p, s)))

    return let(F.regexp_extract_all(normal, rule["pattern"], F.lit(0)),
               lambda hits: F.when(F.size(hits) == 0, F.array().cast(_MATCH)).otherwise(placed(hits)))


def matches(found: Column, table: Sequence[Rule] = RULES) -> Column:
    """All matches of the table's rules in an array of words, by start, longest first, then tier and order of the rules.
    One pass over the words finds the keywords; only their rules are tried."""
    packed = json.dumps([{"label": r.label, "tier": r.tier, "keyword": r.keyword, "pattern": compiled(r.pattern), "base": r.base, "at": i} for i, r in enumerate(table)])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])

    def tried(present: Column) -> Column:
        likely = F.filter(F.from_json(F.lit(packed), _RULE), lambda r: F.array_contains(present, r["keyword"]))
        return let(normal_form(found), lambda n: F.array_sort(F.flatten(F.transform(likely, lambda r: _located(n, r)))))

    return let(F.array_intersect(found, keywords), lambda p: F.when(F.size(p) == 0, F.array().cast(_MATCH)).otherwise(tried(p)))


def kept(found: Column) -> Column:
    """Matches that no other one suppresses. ``found`` is ordered, so whatever contains a match stands before it;
    a match goes if a furthest end before it, among tiers as strong as its own or stronger, reaches its end."""
    tiers = range(len(CONFIDENCE))
    ends = F.transform(found, lambda m: F.struct(*[F.when(m["tier"] <= t, -m["back"]).otherwise(-1).alias(f"t{t}") for t in tiers]))
    zero = F.struct(*[F.lit(-1).alias(f"t{t}") for t in tiers])
    furthest = running(ends, zero, lambda a, b: F.struct(*[F.greatest(a[f"t{t}"], b[f"t{t}"]).alias(f"t{t}") for t in tiers]),
                       "struct<" + ",".join(f"t{t}:int" for t in tiers) + ">")

    def free(f: Column, m: Column, i: Column) -> Column:
        before = F.get(f, i - 1)
        reach = reduce(lambda acc, t: F.when(m["tier"] == t, before[f"t{t}"]).otherwise(acc), tiers, F.lit(-1))
        return F.coalesce(reach, F.lit(-1)) < -m["back"]

    return F.when(F.size(found) < 2, found).otherwise(let(furthest, lambda f: F.filter(found, lambda m, i: free(f, m, i))))


def licensed(docs: DataFrame, table: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, base, found, labels, score: one row per row of ``docs``.

    ``base``: all places of the base phrases, ``found``: matches that were not suppressed; both are
    arrays of (label, start, end, tier), in words from 0, end exclusive, by start. ``labels``: sorted labels of both. ``score``:
    confidence of the strongest match, 0 without one.

    Null and empty texts have no words and no labels; ties (same words, same tier) go to the earlier
    rule; repeated rows and null ids come out as they are; other columns are ignored.
    """
    rows = docs.select("doc_id", words(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", F.size("_w").cast("long").alias("n_words"), matches(F.col("_w"), table).alias("_m"))
    rows = rows.withColumn("_kept", kept(F.col("_m")))
    shown = lambda a: F.transform(a, lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), (-m["back"]).alias("end"), m["tier"].alias("tier")))
    sure = F.array(*[F.lit(c) for c in CONFIDENCE])
    base = F.filter("_m", lambda m: m["base"])
    return rows.select("doc_id", "n_words", shown(base).alias("base"), shown(F.col("_kept")).alias("found"),
                       F.array_sort(F.array_distinct(F.transform(F.concat(base, F.col("_kept")), lambda m: m["label"]))).alias("labels"),
                       F.coalesce(F.get(sure, F.array_min(F.transform("_kept", lambda m: m["tier"]))), F.lit(0.0)).alias("score"))
