"""Alignment of a reference and an observed symbol sequence, one pair per row.

Cost matrices are folds over the reference (``aggregate``), so they run inside the JVM and
Spark spreads pairs. Sequences are recordings: tens of symbols, not whole books.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.inventory import VOWELS, strings
from strophe.functions.scalars import ratio
from strophe.functions.vectors import let

Cost = Callable[[Column, Column], Column]


def unit_cost(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(1.0)


def set_cost(accepted: Column, b: Column) -> Column:
    """Zero when the observed symbol is one of the accepted ones."""
    return F.when(F.array_contains(accepted, b), 0.0).otherwise(1.0)


def category_cost(a: Column, b: Column) -> Column:
    """Substitution cost by sound category: 0, 0.15, 0.6, 1 or 2.2."""
    def either(x: str, y: str) -> Column:
        return ((a == x) & (b == y)) | ((a == y) & (b == x))

    vowels, folded = list(VOWELS), ["AX", "DX"]
    near = (a.isin(folded) | b.isin(folded)) & (either("AX", "AH") | either("DX", "T") | either("DX", "D"))
    return (F.when(a == b, 0.0)
            .when(a.isin(vowels) == b.isin(vowels), F.when(near, 0.15).otherwise(1.0))
            .when(either("Y", "IY") | either("W", "UW"), 0.6).otherwise(2.2))


def cost_matrix(ref: Column, obs: Column, cost: Cost) -> Column:
    """Matrix of (len(ref)+1) rows and (len(obs)+1) columns of minimal prefix costs."""
    zero = F.transform(F.sequence(F.lit(0), F.size(obs)), lambda j: j.cast("double"))

    def next_row(prev: Column, r: Column) -> Column:
        def cell(acc: Column, o: Column) -> Column:
            j = F.size(acc)
            best = F.least(F.get(prev, j - 1) + cost(r, o), F.get(prev, j) + 1.0, F.get(acc, j - 1) + 1.0)
            return F.concat(acc, F.array(best))

        return F.aggregate(obs, F.array(F.get(prev, F.lit(0)) + 1.0), cell)

    def grow(rows: Column, r: Column) -> Column:
        return F.concat(rows, F.array(next_row(F.element_at(rows, -1), r)))

    return F.aggregate(ref, F.array(zero), grow)


def set_edit_distance(ref: Column, obs: Column) -> Column:
    """Unit-cost distance to a reference of accepted sets."""
    return let(cost_matrix(ref, obs, set_cost), lambda m: F.element_at(F.element_at(m, -1), -1)).cast("int")


def edit_distance(ref: Column, obs: Column, inventory: Sequence[str]) -> Column:
    """Unit-cost distance between symbol arrays: symbols become single characters and the
    built-in ``levenshtein`` does the rest in generated code. Symbols outside the inventory take
    codes of their own, so that two of them are equal only if they are the same."""
    known = strings(inventory)

    def distance(every: Column) -> Column:
        # one code point per symbol, from the supplementary planes
        code = lambda s: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(every, s)), 8, "0")), "UTF-32")
        return F.levenshtein(F.concat_ws("", F.transform(ref, code)), F.concat_ws("", F.transform(obs, code)))

    return let(F.array_union(known, F.array_union(ref, obs)), distance)


def align(ref: Column, obs: Column, cost: Cost) -> Column:
    """Array of (r, o) index pairs, null for a gap; ties go to diagonal, then deletion, then insertion."""

    def trace(m: Column) -> Column:
        n, k = F.size(ref), F.size(obs)

        def at(i: Column, j: Column) -> Column:
            return F.get(F.get(m, i), j)

        def step(acc: Column, _: Column) -> Column:
            i, j = acc["i"], acc["j"]
            here = at(i, j)
            diagonal = (i > 0) & (j > 0) & (at(i - 1, j - 1) + cost(F.get(ref, i - 1), F.get(obs, j - 1)) == here)
            removed = (i > 0) & ((j == 0) | (at(i - 1, j) + 1.0 == here))
            pair = lambda r, o: F.struct(r.cast("int").alias("r"), o.cast("int").alias("o"))
            none = F.lit(None)
            move = lambda di, dj, p: F.struct((i - di).alias("i"), (j - dj).alias("j"), F.concat(F.array(p), acc["pairs"]).alias("pairs"))
            return (F.when((i == 0) & (j == 0), acc)
                    .when(diagonal, move(1, 1, pair(i - 1, j - 1)))
                    .when(removed, move(1, 0, pair(i - 1, none)))
                    .otherwise(move(0, 1, pair(none, j - 1))))

        start = F.struct(n.alias("i"), k.alias("j"), F.array().cast("array<struct<r:int,o:int>>").alias("pairs"))
        steps = F.when(n + k > 0, F.sequence(F.lit(1), n + k)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step)["pairs"]

    return let(cost_matrix(ref, obs, cost), trace)


def _labelled(pairs: Column, ref: Column, obs: Column) -> Column:
    """Per reference index: event, realised symbol and observed index."""
    rows = F.filter(pairs, lambda p: p["r"].isNotNull())

    def label(p: Column) -> Column:
        seen = F.get(obs, p["o"])
        event = F.when(p["o"].isNull(), "deletion").when(seen == F.get(ref, p["r"]), "match").otherwise("substitution")
        return F.struct(p["r"].alias("idx"), event.alias("event"), seen.alias("realized"), p["o"].alias("observed_index"))

    return F.transform(rows, label)


def consensus_labels(pairs: DataFrame, key: Sequence[str], ref: str, obs: str, minimum: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """(tokens, summary): a position is stable when both alignments agree on event and symbol.

    The two alignments are columns of the same row, so agreement needs no join.
    """
    r, o = F.col(ref), F.col(obs)
    both = pairs.select(*key, ref, obs, align(r, o, unit_cost).alias("_u"), align(r, o, category_cost).alias("_c"))
    both = both.select(*key, ref, _labelled(F.col("_u"), r, o).alias("_lu"), _labelled(F.col("_c"), r, o).alias("_lc"), "_u", "_c")
    inserted = lambda c: F.transform(F.filter(c, lambda p: p["r"].isNull()), lambda p: p["o"])
    both = both.withColumns({"_iu": inserted(F.col("_u")), "_ic": inserted(F.col("_c"))}).drop("_u", "_c")

    def merge(u: Column, c: Column) -> Column:
        stable = (u["event"] == c["event"]) & u["realized"].eqNullSafe(c["realized"])
        return F.struct(
            u["idx"].alias("idx"), stable.alias("stable"), F.when(stable, u["event"]).otherwise("alignment_uncertain").alias("event_type"),
            F.when(stable, u["realized"]).alias("realized"), u["event"].alias("unit_event"), c["event"].alias("category_event"),
            u["realized"].alias("unit_realized"), c["realized"].alias("category_realized"))

    both = both.withColumn("_t", F.zip_with("_lu", "_lc", merge)).drop("_lu", "_lc")
    tokens = both.select(*key, F.explode("_t").alias("_x")).select(*key, "_x.*")
    n_stable = F.size(F.filter("_t", lambda t: t["stable"]))
    summary = both.select(
        *key, F.size("_t").alias("n_positions"), n_stable.alias("n_stable"),
        F.coalesce(ratio(n_stable, F.size("_t")), F.lit(0.0)).alias("stable_fraction"),
        F.size("_iu").alias("unit_insertions"), F.size("_ic").alias("category_insertions"),
        F.size(F.array_intersect("_iu", "_ic")).alias("agreed_insertions"))
    return tokens, summary.withColumn("eligible", (F.col("n_positions") > 0) & (F.col("stable_fraction") >= minimum))


def optimal_cells(pairs: DataFrame, ref: str, obs: str) -> DataFrame:
    """Add forward and backward cost matrices and the optimum for a reference of accepted sets."""
    r, o = F.col(ref), F.col(obs)
    out = pairs.withColumns({"_fwd": cost_matrix(r, o, set_cost), "_rev": cost_matrix(F.reverse(r), F.reverse(o), set_cost)})
    flip = F.reverse(F.transform("_rev", lambda row: F.reverse(row)))
    return out.withColumn("_bwd", flip).withColumn("_opt", F.element_at(F.element_at("_fwd", -1), -1)).drop("_rev")


def _grid(a: str, i: Column, j: Column) -> Column:
    return F.get(F.get(F.col(a), i), j)


def _edges(ref: str, obs: str) -> tuple[Callable, Callable, Callable]:
    """Predicates: deletion at (i,j), diagonal at (i,j), insertion at (i,j) lie on an optimal path."""
    r, o = F.col(ref), F.col(obs)
    dele = lambda i, j: _grid("_fwd", i, j) + 1 + _grid("_bwd", i + 1, j) == F.col("_opt")
    diag = lambda i, j: _grid("_fwd", i, j) + set_cost(F.get(r, i), F.get(o, j)) + _grid("_bwd", i + 1, j + 1) == F.col("_opt")
    ins = lambda i, j: _grid("_fwd", i, j) + 1 + _grid("_bwd", i, j + 1) == F.col("_opt")
    return dele, diag, ins


def _cols(obs: str, inclusive: bool) -> Column:
    """Observed indices 0..m (inclusive) or 0..m-1."""
    m = F.size(F.col(obs))
    if inclusive:
        return F.sequence(F.lit(0), m)
    return F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))


def optimal_labels(cells: DataFrame, key: Sequence[str], ref: str, obs: str, diagnostic: str | None = None) -> DataFrame:
    """Per position, what every minimum-cost alignment says: (event, symbol) sets and stability.

    ``stable_error`` when all agree on error or not, ``stable_event`` when all agree on event
    and symbol. One output row per reference position.
    """
    dele, diag, _ = _edges(ref, obs)
    o = F.col(obs)
    n = F.size(F.col(ref))
    pos = cells.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    i = F.col("idx")
    gone = F.when(F.exists(_cols(obs, True), lambda j: dele(i, j)),
                  F.array(F.struct(F.lit("deletion").alias("event"), F.lit(None).cast("string").alias("symbol"))))
    hits = F.transform(F.filter(_cols(obs, False), lambda j: diag(i, j)), lambda j: F.struct(
        F.when(F.array_contains(F.get(F.col(ref), i), F.get(o, j)), "match").otherwise("substitution").alias("event"), F.get(o, j).alias("symbol")))
    empty = F.array().cast("array<struct<event:string,symbol:string>>")
    pos = pos.withColumn("_set", F.array_sort(F.array_distinct(F.concat(F.coalesce(gone, empty), hits))))
    errors = F.array_distinct(F.transform("_set", lambda e: e["event"] != "match"))
    ok = F.get(F.col(diagnostic), i) if diagnostic else F.lit(True)
    se, sv = ok & (F.size(errors) == 1), ok & (F.size("_set") == 1)
    only = F.get("_set", F.lit(0))
    return pos.select(
        *key, "idx", ok.alias("diagnostic"), F.when(se, F.get(errors, F.lit(0))).alias("is_error"), se.alias("stable_error"), sv.alias("stable_event"),
        F.when(sv, only["event"]).otherwise("alignment_uncertain").alias("event_type"), F.when(sv, only["symbol"]).alias("realized"),
        F.col("_set").alias("candidates"), F.col("_opt").cast("int").alias("distance"))


def gap_labels(cells: DataFrame, key: Sequence[str], ref: str, obs: str, diagnostic: str | None = None) -> DataFrame:
    """Per gap 0..n, the sequences that optimal alignments insert there, and whether they agree."""
    dele, diag, ins = _edges(ref, obs)
    n, m = F.size(F.col(ref)), F.size(F.col(obs))
    g = cells.select("*", F.explode(F.sequence(F.lit(0), n)).alias("gap"))
    i = F.col("gap")
    none = F.array().cast("array<int>")
    came = F.when(i == 0, F.array(F.lit(0))).otherwise(F.array_union(
        F.filter(_cols(obs, True), lambda j: dele(i - 1, j)),
        F.transform(F.filter(_cols(obs, False), lambda j: diag(i - 1, j)), lambda j: j + 1)))
    left = F.when(i == n, F.array(m)).otherwise(F.array_union(
        F.filter(_cols(obs, True), lambda j: dele(i, j)), F.filter(_cols(obs, False), lambda j: diag(i, j))))
    g = g.withColumns({"_in": F.coalesce(came, none), "_out": F.coalesce(left, none), "_ins": F.filter(_cols(obs, False), lambda j: ins(i, j))})

    def runs(s: Column) -> Column:
        inside = lambda e: F.when(e > s, F.sequence(s, e - 1)).otherwise(none)
        ends = F.filter("_out", lambda e: (e >= s) & (F.size(F.array_except(inside(e), F.col("_ins"))) == 0))
        return F.transform(ends, lambda e: F.slice(F.col(obs), s + 1, e - s))

    g = g.withColumn("sequences", F.array_sort(F.array_distinct(F.flatten(F.transform("_in", runs)))))
    if diagnostic:
        d = F.col(diagnostic)
        ok = ((i == 0) | F.get(d, F.greatest(i - 1, F.lit(0)))) & ((i == n) | F.get(d, F.least(i, n - 1)))
    else:
        ok = F.lit(True)
    stable = ok & (F.size("sequences") == 1)
    longest = F.array_max(F.transform("sequences", lambda s: F.size(s)))

    def ordinal(k: Column) -> Column:
        seen = F.array_sort(F.array_distinct(F.transform("sequences", lambda s: F.get(s, k))))
        fixed = ok & (F.size(seen) == 1)
        present = F.array_distinct(F.transform(seen, lambda p: p.isNotNull()))
        return F.struct(k.alias("ordinal"), fixed.alias("stable"), F.when(ok & (F.size(present) == 1), F.get(present, F.lit(0))).alias("present"),
                        F.when(fixed, F.get(seen, F.lit(0))).alias("symbol"))

    slots = F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), ordinal)).otherwise(
        F.array().cast("array<struct<ordinal:int,stable:boolean,present:boolean,symbol:string>>"))
    return g.select(*key, "gap", ok.alias("diagnostic"), stable.alias("stable"), F.when(stable, F.get("sequences", F.lit(0))).alias("inserted"),
                    "sequences", slots.alias("ordinals"))


def greedy_label_scores(labels: DataFrame, gaps: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scores of a greedy decoding: +1 ok, -1 error, 0 unstable; gap slots 1, 0 or 0.5."""
    score = F.when(F.col("stable_error"), F.when(F.col("is_error"), -1.0).otherwise(1.0)).otherwise(0.0)
    conf = F.when(F.col("stable_event"), 1.0).otherwise(0.0)
    tokens = labels.select(
        *key, "idx", score.alias("gop"), F.when(F.col("stable_event"), F.col("event_type")).otherwise("unspecified").alias("cand_event"),
        F.when(F.col("event_type") == "substitution", F.col("realized")).alias("cand_symbol"), conf.alias("cand_conf"))
    slot = gaps.select(*key, "gap", "ordinals", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("_o", F.get("ordinals", F.col("ordinal")))
    sure = F.col("_o").isNull() | F.col("_o.stable")
    prob = F.when(F.col("_o").isNull(), 0.0).when(F.col("_o.stable"), F.col("_o.present").cast("double")).otherwise(0.5)
    slots = slot.select(*key, "gap", "ordinal", prob.alias("insertion_probability"), F.col("_o.symbol").alias("slot_symbol"),
                        F.when(sure, 1.0).otherwise(0.0).alias("cand_conf"))
    return tokens, slots


def word_context(words: DataFrame, doc: str, pos: str, word: str, length: Column) -> DataFrame:
    """Neighbouring words and symbol offsets of every word of a text (a text arrives as one row)."""
    w = Window.partitionBy(doc).orderBy(pos)
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return words.select(doc, pos, word, F.lag(word).over(w).alias("left_word"), F.lead(word).over(w).alias("right_word"),
                        (end - length).alias("start"), end.alias("end"))
