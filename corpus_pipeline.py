"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Stages read their input more than once, so it is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import line_dedup, mixing, ngram_join, ordinal, packing
from fathom.llm.common import materialize


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each id and text (null: empty), the least by the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")).agg(F.min(F.struct(*others, "text")).alias("row"))
    return rows.select(*("doc_id" if c == "doc_id" else f"row.{c}" for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the rated documents among docs; the rejected ones go."""
    grades = ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select(docs, ordinal.train(docs, grades))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first stays; documents without any line left go."""
    return line_dedup.rewrite(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike documents the first stays, and of its repeated rows one."""
    return one_of_each(ngram_join.keep_first(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' target weights, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of full length; the pieces of the last stage."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]
#: Hashing, regression and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
