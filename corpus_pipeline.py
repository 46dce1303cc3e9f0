"""The corpus pipeline: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last returns
one row of token digests per document that is left. In every stage null texts are empty ones, null ids, languages and
sources are values like others, rows repeated whole share one fate, and columns other than those of ``documents`` are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import cotrain, decontaminate, line_dedup, part_enum
from strophe.llm.common import table, written
from strophe.llm.queries import bpe_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Some stages learn a model; SQL can't state their rows.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Rows that share an id but not the text are judged each by its own text;
    without labels every document scores one half and stays."""
    model = cotrain.trained(docs, table(spark, sf_dir, "labels"))
    return cotrain.scored(docs, model, carry=COLUMNS).where("accepted").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; no document goes. Rows that share an id count as one document
    for a line; a null id owns no line."""
    out = line_dedup.drop_shared_lines(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; documents without an id stay. Of documents that share an id
    none goes while one of them is nobody's copy, as the id alone can't tell them apart."""
    classes = part_enum.near_duplicate_classes(docs)
    own = F.max((F.coalesce("component_id", "doc_id") == F.col("doc_id")).cast("int"))
    gone = written(classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(own.alias("own")).where("own = 0").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, told apart by id and text: a clean text stays whatever shares its id."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("_d"), F.col("_v").alias("_dv")), "contaminated")
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (version == F.col("_dv")), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded again by the byte-level BPE; one row of digests per row, null texts have no tokens."""
    return bpe_digests(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
