"""Reciprocal rank fusion of any number of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def fuse(lists: list[DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """qid, id, score, ranks (each list's rank or null) from lists of (qid, id, rank); one shuffle."""
    tagged = reduce(DataFrame.unionByName, (r.select("qid", "id", "rank", F.lit(i).alias("list")) for i, r in enumerate(lists)))
    ranks = F.array(*(F.min(F.when(F.col("list") == i, F.col("rank"))) for i in range(len(lists))))
    parts = reduce(lambda a, b: a + b, (F.coalesce(F.sum(F.when(F.col("list") == i, 1.0 / (k + F.col("rank")))), F.lit(0.0)) for i in range(len(lists))))
    return tagged.groupBy("qid", "id").agg(parts.alias("score"), ranks.alias("ranks"))


def top_k(fused: DataFrame, n_lists: int, k: int) -> DataFrame:
    """The first k per query by score; ties in the order in which the lists, one after the other, show them."""
    ties = [F.asc_nulls_last(F.get("ranks", F.lit(i))) for i in range(n_lists)]
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), *ties, "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
