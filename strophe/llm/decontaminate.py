"""Exact phrase and proximity search of benchmark items in a corpus (DataFrame functions only).

The corpus becomes a positional inverted index: one row per posting (term, document, position),
written to the shared folder, restricted to the terms that the items use, with one closing
posting per document that holds its length. Every window of an item is looked up from its
rarest term; list positions are compared after subtracting the term's offset in the item, so
that an item standing in a document is one alignment (document, item, shift). The lists of
the other terms are intersected at those alignments only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import lower_az, maybe_in, written

#: Everything outside words, A-Z included as they are lower-cased first.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
#: Item tables are sent to all tasks only up to this many rows; beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def _words(text):
    """Words of a lower-cased text; a leading or trailing gap leaves an empty one."""
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """(_item, item_id, _len, _at, term): the words of each item with their positions; an item is an (item_id, text), null ids included."""
    w = items.select(F.xxhash64("item_id", "text").alias("_item"), "item_id", _words(lower_az(F.col("text"))).alias("_w"))
    w = w.groupBy("_item").agg(F.first("item_id").alias("item_id"), F.max("_w").alias("_w"))
    return w.select("_item", "item_id", F.size("_w").alias("_len"), F.posexplode("_w").alias("_at", "term"))


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(doc_id, _v, _pos, _t): postings of ``terms`` (term, _t); the closing posting has a null _t."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("_v"), F.concat(_words(lower_az(F.col("text"))), F.array(F.lit(""))).alias("_w"))
    flat = d.select("doc_id", "_v", F.posexplode("_w").alias("_pos", "term"))
    closing = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(None).cast("long").alias("_t"))
    return flat.join(_small(terms.select("term", "_t").unionByName(closing), rows), "term").select("doc_id", "_v", "_pos", "_t")


def alignments(index: DataFrame, terms: DataFrame, rows: int, window: int) -> DataFrame:
    """(doc_id, _v, _item, _shift, _lo, _hi): where the rarest term of a window stands, with the item
    positions around it that windows anchored there cover."""
    counts = index.where(F.col("_t").isNotNull()).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    known = terms.join(_small(counts, rows), "_t", "left")
    starts = known.where((F.col("_at") == 0) | (F.col("_at") <= F.col("_len") - window)).select("_item", F.col("_at").alias("_start"))
    inside = starts.join(known, "_item").where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + window))
    # a window with a term that the corpus lacks can't occur
    rarest = inside.groupBy("_item", "_start", "_len").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_at", "_t")).alias("_r")).where("_r._n > 0")
    anchors = rarest.groupBy("_item", F.col("_r._t").alias("_t"), F.col("_r._at").alias("_at")).agg(
        F.min("_start").alias("_lo"), F.max(F.least(F.col("_start") + window, F.col("_len")) - 1).alias("_hi"))
    at = index.join(_small(anchors, rows), "_t")
    return at.groupBy("doc_id", "_v", "_item", (F.col("_pos") - F.col("_at")).alias("_shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("_lo", "_hi")))).alias("_need"))


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index, and (doc_id, _v, _item, _shift, _from, _to, item_id): maximal stretches of item words, by
    positions in the item, that stand in a document and hold at least one whole window.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole.
    """
    words = written(item_terms(items), "items")
    vocabulary = written(words.groupBy("term").agg(F.min(F.xxhash64("term")).alias("_t")), "terms")
    n = words.count()
    terms = words.join(_small(vocabulary, n), "term")
    index = written(postings(docs, vocabulary, n), "postings")
    need = alignments(index, terms, n, window).select("doc_id", "_v", "_item", "_shift", F.explode("_need").alias("_at"))
    need = need.join(_small(terms.select("_item", "_at", "_t", "_len"), n), ["_item", "_at"])
    need = need.withColumn("_pos", F.col("_shift") + F.col("_at")).where("_pos >= 0")
    need = written(need, "need")
    listed = maybe_in(index.where(F.col("_t").isNotNull()), need, "doc_id", "_v").select(
        F.col("doc_id").alias("_d"), F.col("_v").alias("_dv"), F.col("_pos").alias("_dpos"), F.col("_t").alias("_dt"))
    found = need.join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_v") == F.col("_dv"))
                      & (F.col("_pos") == F.col("_dpos")) & (F.col("_t") == F.col("_dt")), "left_semi")
    # consecutive item positions of one alignment share (position - rank); an alignment has at most an item's words
    rank = F.row_number().over(Window.partitionBy("doc_id", "_v", "_item", "_shift").orderBy("_at"))
    runs = found.withColumn("_run", F.col("_at") - rank).groupBy("doc_id", "_v", "_item", "_shift", "_run").agg(
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.min("_len").alias("_len"))
    runs = runs.where(F.col("_to") - F.col("_from") + 1 >= F.least(F.lit(window), F.col("_len"))).drop("_run", "_len")
    return index, runs.join(_small(words.where("_at = 0").select("_item", "item_id"), n), "_item")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids as sorted strings), contaminated; also _v.

    n_hit counts the words of a document inside any occurrence of a window of any item;
    contaminated means n_hit > 0 and 100 * n_hit >= ``min_percent`` * n_words.

    One row per distinct (doc_id, text), null ids included; rows repeated whole come out once.
    Null and empty texts have no words. Items without words match nothing. Every text of a repeated
    item id counts, and the id is listed once; items with a null id count for n_hit and are not listed. Other columns are ignored.
    """
    index, runs = phrase_hits(docs, items, window)
    runs = written(runs, "runs")
    lengths = index.where(F.col("_t").isNull()).select("doc_id", "_v", F.col("_pos").alias("_n"))
    words = runs.select("doc_id", "_v", F.explode(F.sequence(F.col("_shift") + F.col("_from"), F.col("_shift") + F.col("_to"))).alias("_pos"))
    marks = words.distinct().groupBy("doc_id", "_v").agg(F.count(F.lit(1)).alias("_hit"))
    which = runs.groupBy("doc_id", "_v").agg(F.collect_set(F.col("item_id").cast("string")).alias("_items"))
    none = F.lit(None)
    rows = (lengths.select("doc_id", "_v", "_n", none.cast("long").alias("_hit"), none.cast("array<string>").alias("_items"))
            .unionByName(marks.select("doc_id", "_v", none.cast("int").alias("_n"), "_hit", none.cast("array<string>").alias("_items")))
            .unionByName(which.select("doc_id", "_v", none.cast("int").alias("_n"), none.cast("long").alias("_hit"), "_items")))
    out = rows.groupBy("doc_id", "_v").agg(
        F.max("_n").cast("long").alias("n_words"), F.coalesce(F.max("_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce(F.max("_items"), F.array().cast("array<string>"))).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))


def proximity_hits(docs: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(doc_id, item_id, position, span): items all of whose distinct words lie within ``within``
    words of an occurrence of the item's rarest word, in any order; the tightest such place per document and item.

    Lists are joined on the document only at places of the rarest word. Nulls and repeats as in ``contamination``.
    """
    words = written(item_terms(items).select("_item", "item_id", "term").distinct(), "items")
    vocabulary = written(words.groupBy("term").agg(F.min(F.xxhash64("term")).alias("_t")), "terms")
    n = words.count()
    terms = words.join(_small(vocabulary, n), "term")
    index = written(postings(docs, vocabulary, n).where(F.col("_t").isNotNull()), "postings")
    counts = index.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    known = terms.join(_small(counts, n), "_t", "left")
    rarest = known.groupBy("_item").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_t")).alias("_r"), F.count(F.lit(1)).alias("_all"))
    places = index.join(_small(rarest.where("_r._n > 0").select("_item", "_all", F.col("_r._t").alias("_t")), n), "_t").select(
        F.col("doc_id").alias("_d"), F.col("_v").alias("_dv"), F.col("_pos").alias("_p"), "_item", "_all")
    wanted = places.join(_small(terms.select("_item", F.col("_t").alias("_w")), n), "_item")
    block = F.explode(F.array(*[F.floor(F.col("_p") / within).cast("int") + k for k in (-1, 0, 1)]))
    wanted = wanted.withColumn("_b", block)
    lists = index.withColumn("_b", F.floor(F.col("_pos") / within).cast("int"))
    near = wanted.join(lists, wanted["_d"].eqNullSafe(lists["doc_id"]) & (wanted["_dv"] == lists["_v"]) & (wanted["_w"] == lists["_t"])
                       & (wanted["_b"] == lists["_b"])).where(F.abs(F.col("_pos") - F.col("_p")) < within)
    best = near.groupBy("_d", "_dv", "_item", "_p", "_all", "_w").agg(F.min(F.abs(F.col("_pos") - F.col("_p"))).alias("_gap"))
    whole = best.groupBy("_d", "_dv", "_item", "_p", "_all").agg(F.count(F.lit(1)).alias("_k"), F.max("_gap").alias("_span")).where("_k = _all")
    whole = whole.join(_small(words.select("_item", "item_id").distinct(), n), "_item")
    return whole.groupBy(F.col("_d").alias("doc_id"), "_dv", "item_id").agg(
        F.min(F.struct("_span", "_p")).alias("_m")).select("doc_id", "item_id", F.col("_m._p").alias("position"), F.col("_m._span").alias("span"))
