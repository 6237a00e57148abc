"""Stored tables of the engine: filings, chunks, collections, vectors, caches, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines of JSON under a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILING).json(path, multiLine=True)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUND_TRUTH).csv(path, header=True, multiLine=True, escape='"')


def build_collection(chunks: DataFrame, path: str) -> None:
    """Replace a collection: partitioned so that ticker and year filters prune files."""
    chunks.write.mode("overwrite").partitionBy("strategy", "ticker", "fiscal_year").parquet(path)


def read_collection(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("strategy") == strategy) if strategy else rows


def vector_mismatch(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that only one side has: the guard before stored vectors are used."""
    both = chunks.select(key, F.lit(1).alias("c")).join(vectors.select(key, F.lit(1).alias("v")), key, "full_outer")
    return both.where("c is null or v is null").select(key, F.when(F.col("c").isNull(), "no chunk").otherwise("no vector").alias("problem"))


def read_rerank_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, or an empty one where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schemas.RERANK_CACHE).parquet(path) if there else spark.createDataFrame([], schemas.RERANK_CACHE)


def append_rerank_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def lookup(chunks: DataFrame, chunk_id: str, key: str = "chunk_id") -> dict:
    """One chunk by id; KeyError if there is none."""
    found = chunks.where(F.col(key) == chunk_id).limit(1).collect()
    if not found:
        raise KeyError(chunk_id)
    return found[0].asDict(recursive=True)
