"""Reranking of a bounded candidate pool, with a cache and a degenerate-score guard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_hash, tokens

#: (queries, texts) -> scores; called once per Arrow batch, after loading whatever it needs.
Scorer = Callable[[list[str], list[str]], list[float]]


def lexical_scores(pairs: DataFrame) -> DataFrame:
    """The offline default: the share of a query's distinct words that occur in the text.  Native."""
    asked = F.array_distinct(tokens("query"))
    share = F.size(F.array_intersect(asked, tokens("text"))) / F.greatest(F.size(asked), F.lit(1))
    return pairs.withColumn("score", F.round(share, 6))


def model_scores(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """score by a model, for pairs with columns query and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(scorer(batch["query"].to_pylist(), batch["text"].to_pylist()), pa.float64()))

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())]))


def cached(pairs: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame], model: str = "lexical") -> tuple[DataFrame, DataFrame]:
    """(scored pairs, rows to add to the cache).

    The cache is keyed by query, document, model and text, so a changed text or model is
    scored anew; only pairs that it lacks are scored.  pairs: qid, id, query, text, ...
    """
    keyed = pairs.withColumn("query_hash", query_hash(F.col("query"))).withColumn("text_hash", F.md5("text")).withColumn("model", F.lit(model))
    keys = ["query_hash", "id", "model", "text_hash"]
    known = cache.select(*keys, "score").dropDuplicates(keys)
    hits = keyed.join(known, keys)
    fresh = score(keyed.join(known, keys, "left_anti"))
    return hits.unionByName(fresh.select(*hits.columns)), fresh.select(*keys, "score").dropDuplicates(keys)


def degenerate(scored: DataFrame) -> DataFrame:
    """Queries whose (two or more) candidates all have one score: a broken model, most likely."""
    return scored.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).where("n >= 2 and low = high").select("qid", "n")


def reorder(scored: DataFrame, k: int) -> DataFrame:
    """The first k per query by score; ties keep the candidates' order (column rank), which rank replaces."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return scored.withColumn("new", F.row_number().over(order)).where(F.col("new") <= k).drop("rank").withColumnRenamed("new", "rank")
