"""Lines that many documents share are removed from all but one of them (DataFrame functions only).

Lines are exploded and hashed once; documents are counted per hash; the positions to drop
are gathered per document, so line texts are never shuffled by line and a line found in a
third of all documents is one pre-aggregated row. Each document is then put together again
from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import BLANKS, let, lower_az, same, written

MIN_CHARS = 40
MIN_DOCS = 5


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, _v, _pos, _h1, _h2): every line whose key has ``min_chars`` code points or more."""
    lines = docs.select("doc_id", "_v", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.where(F.length("_line") >= min_chars)  # trimming can only shorten
    keys = lines.select("doc_id", "_v", "_pos", lower_az(F.btrim("_line", F.lit(BLANKS))).alias("_key"))
    return keys.where(F.length("_key") >= min_chars).select(
        "doc_id", "_v", "_pos", F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns named in ``carry``, text, n_lines, n_dropped.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points that ``min_docs`` or more doc_ids hold lose their lines
    everywhere but in the largest of those doc_ids. Keys are compared by a 128-bit hash.

    A null text is an empty one: one empty line. Rows that share a doc_id are one document for
    the counts. A null doc_id neither counts nor owns a line, but loses shared lines. Repeats of
    a key inside its owner stay. Other columns of ``docs`` are ignored, whatever their names.
    """
    base = docs.select("doc_id", F.struct(F.lit(0).alias("_0"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]).alias("_rest"),
                       F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_v", F.xxhash64("text"))
    keys = written(line_keys(base, min_chars), "lines")
    shared = keys.groupBy("_h1", "_h2").agg(F.count_distinct("doc_id").alias("_n"), F.max("doc_id").alias("_owner"))
    shared = written(shared.where(F.col("_n") >= min_docs), "shared-lines")  # both sides of the join can then be split
    drops = keys.join(shared, ["_h1", "_h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_owner")))
    drops = drops.groupBy("doc_id", "_v").agg(F.collect_set("_pos").alias("_drop"))
    b, d = base.alias("b"), drops.alias("d")
    joined = b.join(d, same(base, drops, "doc_id", "_v"), "left").select("b.*", "d._drop")
    def reassembled(ls):
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(let(lines, reassembled))
    return joined.select(
        "doc_id", *[F.col(f"_rest._c{i}").alias(c) for i, c in enumerate(carry)], kept.alias("text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
